"""Report-ready tables, one function per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals import CLUSTER_KEYS, KEYS
from fleetvitals.functions import fixed_values as fv
from fleetvitals.functions import scalars as S
from fleetvitals.operators import fleet, workload
from fleetvitals.operators.ranking import top_k

TABLE = ["table_schema", "table_name"]


def key_facts(
    topology: DataFrame,
    totals: DataFrame,
    labels: DataFrame,
    priorities: DataFrame,
    backup: DataFrame,
    cluster_keys: list[str] = CLUSTER_KEYS,
) -> DataFrame:
    """One row per cluster; every input already has one row per cluster."""
    zero = F.lit(0).cast("bigint")
    return (
        topology.select(*cluster_keys, F.col("label").alias("topology"), "n_nodes")
        .join(totals.select(*cluster_keys, "total"), cluster_keys, "left")
        .join(labels.select(*cluster_keys, F.col("label").alias("assessment")), cluster_keys, "left")
        .join(priorities, cluster_keys, "left")
        .join(backup.select(*cluster_keys, F.col("severity").alias("backup_severity")), cluster_keys, "left")
        .withColumns({p: F.coalesce(p, zero) for p in ("p0", "p1", "p2", "p3")})
    )


def node_inventory(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    os = S.os_lifecycle("os_release")
    return nodes.select(
        *keys,
        F.coalesce("hostname", F.lit("-")).alias("hostname"),
        "role",
        "needs_confirmation",
        "server_version",
        F.coalesce(fleet.variable("server_id"), F.lit("-")).alias("server_id"),
        S.uptime_short("uptime_sec").alias("uptime"),
        "os_release",
        F.coalesce(os["status"], F.lit("unrecognised")).alias("os_status"),
        os["eol_date"].alias("os_eol_date"),
        S.truncate("os_kernel", 50).alias("os_kernel"),
        S.truncate("cpu_model", 40).alias("cpu_model"),
        "cpu_cores",
        "mem_total_kb",
        "mem_used_kb",
        F.round("mem_pct", 1).alias("mem_pct"),
        "swap_total_kb",
        "swap_used_kb",
        F.round("swap_pct", 1).alias("swap_pct"),
    )


def disk_usage(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mounts with their band; the key mount is /data, else the root."""
    mounts = F.transform("disks", lambda d: d["mount"])
    key_mount = F.when(F.array_contains(mounts, "/data"), "/data").when(F.array_contains(mounts, "/"), "/")
    rows = nodes.select(*keys, key_mount.alias("key_mount"), F.explode("disks").alias("d"))
    return rows.select(
        *keys,
        "d.mount",
        "d.use_pct",
        S.disk_band("d.use_pct").alias("band"),
        F.coalesce(F.col("d.mount") == F.col("key_mount"), F.lit(False)).alias("is_key"),
    )


def connection_usage(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    limit = fleet.number("max_connections").cast("bigint")
    used = F.coalesce("threads_connected", F.lit(0))
    pct = F.coalesce(F.try_divide(used * 100.0, F.nullif(limit, F.lit(0))), F.lit(0.0))
    return nodes.select(
        *keys,
        "role",
        used.cast("bigint").alias("used"),
        limit.alias("max_connections"),
        F.round(pct, 1).alias("pct"),
        S.upper_band(pct, 80, 60).alias("band"),
    )


def _command_counts() -> list[Column]:
    command = F.lower(F.coalesce("command", F.lit("")))
    dump = command.contains("binlog")
    named = [command == "sleep", command == "query", command == "connect", dump]
    other = ~(named[0] | named[1] | named[2] | named[3])
    names = ["sleep", "query", "connect", "binlog_dump"]
    return [
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(c).alias(n) for c, n in zip(named, names)],
        F.count_if(other).alias("other"),
    ]


def session_mix(sessions: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return sessions.groupBy(*keys).agg(*_command_counts())


def long_session_detail(sessions: DataFrame, keys: list[str] = KEYS, k: int = 30, min_s: int = 60) -> DataFrame:
    kept = sessions.filter(workload.is_long_business_session(min_s))
    top = top_k(kept, keys, [F.desc("time_s"), F.asc("session_id")], k)
    return top.withColumn("state", S.truncate("state", 30))


def performance_kpis(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    share = F.round(F.try_divide(F.col("slow_queries") * 100.0, F.nullif(F.col("questions"), F.lit(0))), 4)
    return nodes.select(
        *keys, "role", S.uptime_short("uptime_sec").alias("uptime"), "questions", "qps", "slow_queries",
        F.when(F.col("slow_queries") > 0, share).alias("slow_pct"),
    )


def buffer_pool(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    hit = F.try_divide(F.col("bp_hits") * 100.0, F.nullif(F.col("bp_lookups"), F.lit(0)))
    pages = [c for c in ("bp_pages", "bp_data_pages", "bp_free_pages", "bp_dirty_pages") if c in nodes.columns]
    return nodes.select(
        *keys,
        F.coalesce(fleet.variable("innodb_buffer_pool_size_in_mb"), F.lit("-")).alias("pool_mb"),
        *pages,
        F.round(hit, 1).alias("hit_pct"),
        S.lower_band(hit, 99, 95).alias("band"),
    )


def slow_log_config(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    names = ["slow_query_log", "long_query_time", "slow_query_log_file"]
    return nodes.select(
        *keys, *[F.coalesce(fleet.variable(n), F.lit("-")).alias(n) for n in names], "slow_queries"
    )


def capacity(schema_sizes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return schema_sizes.select(
        *keys, F.when(F.col("is_total"), "total").otherwise(F.col("table_schema")).alias("name"), "size_gb", "is_total"
    )


def tagged_top_tables(top_tables: DataFrame) -> DataFrame:
    kind = F.when(S.is_archive_table("table_name"), "archive").otherwise("business")
    return top_tables.withColumn("table_kind", kind)


def significant_fragments(
    frag_tables: DataFrame, keys: list[str] = KEYS, min_rate: float = 0.7, min_free: int = 104857600
) -> DataFrame:
    heavy = F.col("data_free") >= 10 * S.GIB
    return frag_tables.filter((F.col("frag_rate") >= min_rate) & (F.col("data_free") >= min_free)).select(
        *keys,
        *TABLE,
        "table_rows",
        "data_length",
        "data_free",
        "frag_rate",
        F.when(heavy, "rebuild_first").otherwise("rebuild").alias("rebuild_class"),
    )


def reclaimable(fragments: DataFrame, top_tables: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Bytes that rebuilding and archiving would free, per node."""
    freed = fragments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_fragmented"), F.sum("data_free").cast("bigint").alias("frag_bytes")
    )
    archives = (
        top_tables.filter(S.is_archive_table("table_name"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_archives"), F.sum("bytes").cast("bigint").alias("archive_bytes"))
    )
    zero = F.lit(0).cast("bigint")
    columns = ["n_fragmented", "frag_bytes", "n_archives", "archive_bytes"]
    return freed.join(archives, keys, "full_outer").select(*keys, *[F.coalesce(c, zero).alias(c) for c in columns])


def releasable_space(reclaimable_bytes: DataFrame, total_bytes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Releasable space and its share of the data, where it is at least 1 GiB."""
    freed = F.col("frag_bytes") + F.col("archive_bytes")
    return (
        reclaimable_bytes.filter(freed >= S.GIB)
        .join(total_bytes.select(*keys, F.col("bytes").alias("total_bytes")), keys, "left")
        .select(
            *keys,
            freed.alias("bytes"),
            "frag_bytes",
            "archive_bytes",
            F.floor(F.try_divide(freed * 100.0, F.col("total_bytes")) + 0.5).cast("bigint").alias("pct_of_data"),
        )
    )


def category_counts(objects: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    category = S.table_category("table_name")
    return objects.groupBy(*keys).agg(
        *[F.count_if(category == c).alias(c) for c in ("business", "history", "temp")]
    )


def no_pk_top(no_pk: DataFrame, keys: list[str] = KEYS, k: int = 10, examples: int = 5) -> DataFrame:
    """Largest business tables without primary key, and a few examples of the other categories."""
    tagged = no_pk.withColumn("category", S.table_category("table_name"))
    order = [F.desc_nulls_last("table_rows"), *[F.asc(c) for c in ("table_name", "table_schema")]]
    ranked = top_k(tagged, [*keys, "category"], order, k)
    return ranked.filter((F.col("category") == "business") | (F.col("rnk") <= examples))


def temp_tablespace_status(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Temporary tablespace per node; temp_collected tells an empty section from a missing one."""
    known = F.col("temp_bytes").isNotNull()
    status = F.when(known, "collected").when(
        F.coalesce("temp_collected", F.lit(False)), "collected_no_row"
    ).otherwise("not_collected")
    return nodes.select(
        *keys,
        "role",
        "temp_bytes",
        F.coalesce(fleet.variable("innodb_temp_data_file_path"), F.lit("-")).alias("config"),
        status.alias("status"),
    )


def engine_overview(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    names = [
        "history_list", "log_sequence", "bp_hits", "bp_lookups", "bp_pages", "bp_data_pages",
        "bp_free_pages", "bp_dirty_pages", "pages_read", "pages_created", "pages_written", "latest_deadlock",
    ]
    return nodes.select(*keys, *[n for n in names if n in nodes.columns])


def active_transaction_list(active_trx: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return active_trx.select(*keys, "trx_id", "state", S.truncate("detail", 80).alias("detail"))


# Lock counters of the lock summary.
LOCK_COUNTERS = [
    "Innodb_row_lock_current_waits", "Innodb_row_lock_waits", "Innodb_row_lock_time_avg", "Table_locks_waited",
]


def lock_summary(
    waits: DataFrame, metadata_locks: DataFrame, counters: DataFrame, keys: list[str] = KEYS
) -> DataFrame:
    """Waits, metadata locks and lock counters per node, grouped once after a union."""

    def ones(df: DataFrame, wait: int, meta: int) -> DataFrame:
        none = F.lit(None).cast("string")
        return df.select(*keys, F.lit(wait).alias("w"), F.lit(meta).alias("m"), none.alias("name"), none.alias("value"))

    named = counters.filter(F.col("name").isin(LOCK_COUNTERS)).select(
        *keys, F.lit(0).alias("w"), F.lit(0).alias("m"), "name", F.col("value").cast("string").alias("value")
    )
    rows = ones(waits, 1, 0).unionByName(ones(metadata_locks, 0, 1)).unionByName(named)
    return rows.groupBy(*keys).agg(
        F.sum("w").alias("n_waits"),
        F.sum("m").alias("n_metadata_locks"),
        *[
            F.max(F.when(F.col("name") == n, F.col("value").try_cast("bigint"))).alias(n.lower())
            for n in LOCK_COUNTERS
        ],
    )


def replication_status(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    columns = ["master_host", "io_running", "sql_running", "lag_seconds"]
    extra = [c for c in ("master_log_file", "read_master_log_pos") if c in nodes.columns]
    return nodes.filter(F.coalesce("is_replica", F.lit(False))).select(*keys, "role", *columns, *extra)


def replication_health(nodes: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    healthy = (F.col("io_running") == "Yes") & (F.col("sql_running") == "Yes")
    return (
        nodes.filter(F.coalesce("is_replica", F.lit(False)))
        .groupBy(*cluster_keys)
        .agg(
            F.count_if(healthy).alias("n_healthy"),
            F.count(F.lit(1)).alias("n_replicas"),
            F.max(F.coalesce("lag_seconds", F.lit(0))).alias("max_lag"),
        )
    )


def replication_issues(issues: DataFrame) -> DataFrame:
    return issues.filter(F.col("type").isin(fv.REPLICATION_ISSUES))


# Columns of the object matrix.
OBJECT_TYPES = ["TABLE", "VIEW", "PROCEDURE", "FUNCTION", "TRIGGER", "EVENT"]


def object_matrix(object_counts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    wide = object_counts.groupBy(*keys, "db").pivot("object_type", OBJECT_TYPES).agg(F.sum("cnt"))
    return wide.select(
        *keys, "db", *[F.coalesce(t, F.lit(0)).cast("bigint").alias(f"n_{t.lower()}") for t in OBJECT_TYPES]
    )


def index_top(indexes: DataFrame, order: list[str], keys: list[str] = KEYS, k: int = 30) -> DataFrame:
    """First unused (30) or redundant (15) indexes with their table's category."""
    top = top_k(indexes, keys, [F.asc(c) for c in order], k)
    return top.withColumn("category", S.table_category("table_name"))


def large_column_tables(large_columns: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Large columns per table. A table has at most 4096 columns, so the lists are bounded."""
    grouped = large_columns.groupBy(*keys, *TABLE).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list("column_name")).alias("names"),
        F.array_sort(F.collect_set("data_type")).alias("types"),
    )
    return grouped.withColumns({"names": F.array_join("names", ", "), "types": F.array_join("types", "/")})


def auto_increment_bands(usage: DataFrame) -> DataFrame:
    rate = F.col("rate")
    return usage.withColumn("band", F.when(rate >= 0.8, "urgent").when(rate >= 0.5, "attention").otherwise("normal"))


def action_plan(issues: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Issues of the first three priorities; within a cluster, seq is their order."""
    plan = issues.filter(F.col("priority").isin("P0", "P1", "P2"))
    return plan.select(
        *cluster_keys, "priority", "seq", "type", "node", "description", "action", "sql", "current_value", "recommended_value"
    )


def lineage(dumps: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return dumps.select(*keys, "file_name").distinct()
