"""CAT-*, USR-*, IDX-*: catalog, account and index analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import check
from checks.scalar_checks import AUTO_RATE
from fleetvitals.operators import catalog as C

K = "cluster_id, node_ip"
USER = "table_schema <> 'mysql'"


def plain(df: DataFrame, *drop: str) -> DataFrame:
    return df.drop("snapshot_date", *drop)


def topk(columns: str, source: str, where: str, order: str, k: int, partition: str = K) -> str:
    return f"""SELECT {columns}, CAST(rnk AS INT) AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY {order}) AS rnk
FROM {source} WHERE {where}) WHERE rnk <= {k}"""


@check("cat_01_schema_sizes", f"""
SELECT {K}, table_schema, CAST(sum(data_length + index_length) AS BIGINT) AS bytes,
  round(CAST(sum(data_length + index_length) AS DOUBLE) / 1073741824, 3) AS size_gb, FALSE AS is_total
FROM {{cat_tables}} WHERE {USER} GROUP BY {K}, table_schema
UNION ALL SELECT {K}, NULL, CAST(sum(data_length + index_length) AS BIGINT), round(CAST(sum(data_length + index_length) AS DOUBLE) / 1073741824, 3), TRUE
FROM {{cat_tables}} WHERE {USER} GROUP BY {K}""")
def _(v):
    return plain(C.schema_sizes(v["cat_tables"]))


@check("cat_02_schema_detail", f"""
SELECT s.cluster_id, s.node_ip, s.schema_name AS table_schema, charset, schema_collation, CAST(sum(table_rows) AS BIGINT) AS table_rows,
  floor(sum(data_length) / 1048576.0 * 100) / 100.0 AS data_mb, floor(sum(index_length) / 1048576.0 * 100) / 100.0 AS index_mb,
  floor(sum(data_length + index_length) / 1048576.0 * 100) / 100.0 AS all_mb, floor(sum(data_free) / 1048576.0 * 100) / 100.0 AS free_mb
FROM {{cat_schemata}} s LEFT JOIN {{cat_tables}} t ON s.cluster_id = t.cluster_id AND s.node_ip = t.node_ip AND s.schema_name = t.table_schema
WHERE s.schema_name <> 'mysql' GROUP BY 1, 2, 3, 4, 5""")
def _(v):
    return plain(C.schema_detail(v["cat_schemata"], v["cat_tables"]))


OBJECTS = f"""
SELECT {K}, table_schema AS db, 'TABLE' AS object_type FROM {{cat_tables}} WHERE table_type = 'BASE TABLE'
UNION ALL SELECT {K}, table_schema, 'VIEW' FROM {{cat_tables}} WHERE table_type = 'VIEW'
UNION ALL SELECT {K}, event_schema, 'EVENT' FROM {{cat_events}}
UNION ALL SELECT {K}, trigger_schema, 'TRIGGER' FROM {{cat_triggers}}
UNION ALL SELECT {K}, routine_schema, routine_type FROM {{cat_routines}}"""


def object_counts(v):
    return C.object_counts(v["cat_tables"], v["cat_events"], v["cat_triggers"], v["cat_routines"])


@check("cat_03_object_counts", f"SELECT {K}, db, object_type, count(*) AS cnt FROM ({OBJECTS}) GROUP BY {K}, db, object_type")
def _(v):
    return plain(object_counts(v))


@check("cat_04_top_tables", topk(
    f"{K}, table_schema, table_name, data_length + index_length AS bytes, table_rows, engine, round(CAST(data_length + index_length AS DOUBLE) / 1073741824, 3) AS size_gb",
    "{cat_tables}", USER, "data_length + index_length DESC, table_schema, table_name", 10))
def _(v):
    return plain(C.top_tables(v["cat_tables"]))


@check("cat_05_top_indexes", f"""
WITH top AS ({topk(f"{K}, table_schema, table_name, index_name, stat_value * 16384 AS bytes, round(CAST(stat_value * 16384 AS DOUBLE) / 1048576, 2) AS size_mb",
    "{cat_index_stats}", "index_name NOT IN ('PRIMARY', 'GEN_CLUST_INDEX') AND stat_name = 'size'",
    "stat_value DESC, table_schema, table_name, index_name", 10)}),
cols AS (SELECT {K}, table_schema, table_name, index_name, string_agg(col, ',' ORDER BY seq) AS columns FROM {{cat_index_columns}} GROUP BY ALL)
SELECT top.*, cols.columns FROM top LEFT JOIN cols USING (cluster_id, node_ip, table_schema, table_name, index_name)""")
def _(v):
    return plain(C.top_indexes(v["cat_index_stats"], v["cat_index_columns"]))


RATE = "round(CAST(data_free AS DOUBLE) / (data_length + index_length + data_free), 2)"


@check("cat_06_fragmented_tables", f"""SELECT {K}, table_schema, table_name, table_rows, data_length, index_length, data_free, {RATE} AS frag_rate
FROM {{cat_tables}} WHERE {USER} AND data_length + index_length > 4194304 AND {RATE} > 0.3""")
def _(v):
    return plain(C.fragmented_tables(v["cat_tables"]))


@check("cat_07_non_utf8_tables", f"SELECT {K}, table_schema, table_name, table_collation FROM {{cat_tables}} WHERE {USER} AND table_collation NOT LIKE 'utf8%'")
def _(v):
    return plain(C.non_utf8_tables(v["cat_tables"]))


@check("cat_08_large_columns", f"SELECT {K}, table_schema, table_name, column_name, data_type FROM {{cat_columns}} WHERE {USER} AND (data_type LIKE '%text' OR data_type LIKE '%blob')")
def _(v):
    return plain(C.large_columns(v["cat_columns"]))


@check("cat_09_partition_counts", f"""SELECT {K}, table_schema, table_name, count(*) AS n_partitions
FROM {{cat_partitions}} WHERE {USER} GROUP BY ALL HAVING count(*) > 1""")
def _(v):
    return plain(C.partition_counts(v["cat_partitions"]))


@check("cat_10_non_base_tables", f"SELECT {K}, table_schema, table_name, table_type FROM {{cat_tables}} WHERE {USER} AND table_type <> 'BASE TABLE'")
def _(v):
    return plain(C.non_base_tables(v["cat_tables"]))


@check("cat_11_routines", f"SELECT {K}, routine_schema, routine_name, routine_type, definer FROM {{cat_routines}} WHERE routine_schema <> 'mysql'")
def _(v):
    return plain(C.routines(v["cat_routines"]))


@check("cat_11_schema_charsets", f"SELECT {K}, schema_name, charset, schema_collation FROM {{cat_schemata}} WHERE schema_name <> 'mysql'")
def _(v):
    return plain(C.schema_charsets(v["cat_schemata"]))


@check("cat_12_nonstandard_types", f"SELECT {K}, table_schema, table_name, column_name, data_type FROM {{cat_columns}} WHERE {USER} AND data_type IN ('text', 'longtext', 'json')")
def _(v):
    return plain(C.nonstandard_types(v["cat_columns"]))


AUTO = f"""(SELECT t.cluster_id, t.node_ip, table_schema, table_name, column_name, auto_increment, {AUTO_RATE} AS rate
FROM {{cat_tables}} t JOIN {{cat_columns}} c USING (cluster_id, node_ip, table_schema, table_name)
WHERE extra = 'auto_increment' AND auto_increment IS NOT NULL AND {USER})"""
AUTO_ALL = f"SELECT {K}, table_schema, table_name, column_name, auto_increment, rate FROM {AUTO}"


def auto_increment(v):
    return C.auto_increment_usage(v["cat_tables"], v["cat_columns"])


@check("cat_13_auto_increment_usage", AUTO_ALL)
def _(v):
    return plain(auto_increment(v))


NO_PK = f"""SELECT {K}, table_schema, table_name, table_rows FROM {{cat_tables}} t WHERE {USER} AND table_type = 'BASE TABLE' AND k % 6 = 0"""


def no_pk(v):
    return C.tables_without_pk(v["cat_tables"], v["cat_index_columns"])


@check("cat_14_tables_without_pk", NO_PK)
def _(v):
    return plain(no_pk(v))


@check("cat_15_non_default_engine", f"SELECT {K}, table_schema, table_name, engine FROM {{cat_tables}} WHERE {USER} AND k % 50 = 0")
def _(v):
    return plain(C.non_default_engine(v["cat_tables"]))


@check("cat_15_engines", f"SELECT {K}, engine, support FROM {{cat_engines}}")
def _(v):
    return plain(C.engines(v["cat_engines"]))


@check("cat_15_temp_tablespaces", f"SELECT {K}, name, file_size, allocated_size, autoextend_size FROM {{cat_files}} WHERE name IN ('./ibtmp1', 'innodb_temporary')")
def _(v):
    return plain(C.temp_tablespaces(v["cat_files"]))


@check("cat_16_variable_subset", f"SELECT {K}, 'gtid_mode' AS name, v_gtid_mode AS value FROM {{nodes}} UNION ALL SELECT {K}, 'read_only', v_read_only FROM {{nodes}}")
def _(v):
    return plain(C.variable_subset(v["variables"], ["gtid_mode", "read_only"]))


@check("cat_16_variables_like", f"SELECT {K}, name, value FROM {{variables}} WHERE starts_with(name, 'innodb_')")
def _(v):
    return plain(C.variables_like(v["variables"], "innodb_%"))


@check("cat_16_plugins", f"SELECT {K}, table_name AS plugin, engine AS version, 'STORAGE ENGINE' AS type, table_schema AS library FROM {{cat_tables}} WHERE k % 3 = 0")
def _(v):
    rows = v["cat_tables"].select(
        "cluster_id", "snapshot_date", "node_ip", F.col("table_name").alias("plugin"), F.col("engine").alias("version"),
        F.lit("STORAGE ENGINE").alias("type"), F.col("table_schema").alias("library"),
        F.when(F.col("k") % 3 == 0, "ACTIVE").otherwise("DISABLED").alias("status"),
    )
    return plain(C.plugins(rows))


@check("cat_17_binary_logs", f"SELECT {K}, count(*) AS n_logs, CAST(sum(file_size) AS BIGINT) AS total_bytes, max(log_name) AS last_log FROM {{binlogs}} GROUP BY {K}")
def _(v):
    return plain(C.binary_logs(v["binlogs"]))


@check("cat_17_master_status", f"SELECT {K}, log_name AS file, file_size AS position, 'set' AS executed_gtid_set FROM {{binlogs}}")
def _(v):
    df = v["binlogs"].withColumnsRenamed({"log_name": "file", "file_size": "position"})
    return plain(C.master_status(df.withColumn("executed_gtid_set", F.lit("set"))))


@check("cat_17_gtid_sets", f"SELECT {K}, concat('a:', k) AS gtid_executed, concat('p:', k) AS gtid_purged FROM {{nodes}}")
def _(v):
    pairs = F.array(
        *[F.struct(F.lit(n).alias("name"), F.concat(F.lit(p), F.col("k").cast("string")).alias("value"))
          for n, p in (("gtid_executed", "a:"), ("gtid_purged", "p:"), ("other", "x"))]
    )
    rows = v["nodes"].select("cluster_id", "snapshot_date", "node_ip", F.explode(pairs).alias("p"))
    return plain(C.gtid_sets(rows.select("cluster_id", "snapshot_date", "node_ip", "p.*")))


@check("cat_17_replication_threads", f"SELECT {K}, thread_id, name, command, state FROM {{threads}} WHERE thread_id % 17 IN (0, 1) OR command = 'Binlog Dump'")
def _(v):
    return plain(C.replication_threads(v["threads"]))


@check("cat_17_applier_status", f"""SELECT {K}, channel, count(*) AS n_workers, count(*) FILTER (service_state = 'OFF') AS n_stopped,
  count(*) FILTER (last_error_number = 1032) AS n_errors FROM {{applier_workers}} GROUP BY {K}, channel""")
def _(v):
    return plain(C.applier_status(v["applier_workers"]))


@check("cat_17_connection_status", f"SELECT {K}, channel, service_state, last_error_number, concat('e', worker_id) AS last_error_message FROM {{applier_workers}}")
def _(v):
    df = v["applier_workers"].withColumn("last_error_message", F.concat(F.lit("e"), F.col("worker_id").cast("string")))
    return plain(C.connection_status(df))


@check("cat_17_group_members", f"SELECT {K}, concat('m', k) AS member_id, hostname AS member_host, 'ONLINE' AS member_state, role AS member_role FROM {{nodes}}")
def _(v):
    df = v["nodes"].select(
        "cluster_id", "snapshot_date", "node_ip", F.concat(F.lit("m"), F.col("k").cast("string")).alias("member_id"),
        F.col("hostname").alias("member_host"), F.lit("ONLINE").alias("member_state"), F.col("role").alias("member_role"),
    )
    return plain(C.group_members(df))


@check("cat_17_semi_sync", f"SELECT {K}, name, value FROM {{status}} WHERE starts_with(name, 'Rpl_semi_sync')")
def _(v):
    return plain(C.variables_like(v["status"], "Rpl_semi_sync%"))


@check("usr_01_account_privileges", f"SELECT {K}, user_name, host, plugin, select_priv, super_priv FROM {{cat_users}}")
def _(v):
    return plain(C.account_privileges(v["cat_users"]))


@check("usr_02_expiring_passwords", f"""
SELECT {K}, concat(user_name, '@', host) AS user_host, password_last_changed + CAST(password_lifetime AS INT) AS expire_date FROM {{cat_users}}
WHERE password_lifetime IS NOT NULL AND password_last_changed + CAST(password_lifetime AS INT) - DATE '2024-01-31' < 30""")
def _(v):
    return plain(C.expiring_passwords(v["cat_users"]))


@check("usr_03_connected_users", f"SELECT DISTINCT {K}, user_name, host FROM {{sessions}} WHERE user_name NOT IN ('repl', 'system user')")
def _(v):
    return plain(C.connected_users(v["sessions"]))


@check("usr_04_host_connections", topk(
    f"{K}, host, current_connections, total_connections", "{host_stats}", "TRUE", "total_connections DESC, host", 50))
def _(v):
    return plain(C.host_connections(v["host_stats"]))


@check("usr_05_failed_login_hosts", topk(
    f"{K}, ip, host, connect_errors, handshake_errors, auth_errors", "{host_stats}", "TRUE", "connect_errors DESC, ip, host", 20))
def _(v):
    return plain(C.failed_login_hosts(v["host_stats"]))


IP = "split_part(host, ':', 1)"


@check("usr_06_logins_by_user_ip", f"SELECT {K}, user_name, {IP} AS login_ip, count(*) AS cnt FROM {{sessions}} GROUP BY ALL")
def _(v):
    return plain(C.logins_by_user_ip(v["sessions"]))


@check("usr_07_logins_by_db_user_ip", f"SELECT {K}, db, user_name, {IP} AS login_ip, count(*) AS cnt FROM {{sessions}} GROUP BY ALL")
def _(v):
    return plain(C.logins_by_db_user_ip(v["sessions"]))


UNUSED = f"SELECT {K}, table_schema, table_name, index_name FROM {{index_usage}} WHERE {USER} AND index_name IN ('ix_a', 'ix_c') AND count_star = 0"


@check("idx_01_unused_indexes", UNUSED)
def _(v):
    return plain(C.unused_indexes(v["index_usage"]))


LISTS = f"""SELECT {K}, table_schema, table_name, index_name, min(non_unique) AS nu, string_agg(col, ',' ORDER BY seq) AS cols,
  CASE WHEN index_name = 'PRIMARY' THEN '' ELSE index_name END AS sort_name FROM {{cat_index_columns}} WHERE {USER} GROUP BY ALL"""
REDUNDANT = f"""WITH lists AS ({LISTS}), pairs AS (
SELECT a.cluster_id, a.node_ip, a.table_schema, a.table_name, a.index_name AS redundant_index, b.index_name AS dominant_index,
  a.cols AS redundant_columns, b.cols AS dominant_columns
FROM lists a JOIN lists b USING (cluster_id, node_ip, table_schema, table_name)
WHERE a.index_name <> b.index_name AND ((a.cols = b.cols AND (a.nu > b.nu OR (a.nu = b.nu AND a.sort_name > b.sort_name)))
  OR (starts_with(b.cols, concat(a.cols, ',')) AND a.nu = 1) OR (starts_with(a.cols, concat(b.cols, ',')) AND b.nu = 0)))
SELECT * FROM pairs"""


@check("idx_02_redundant_indexes", REDUNDANT)
def _(v):
    return plain(C.redundant_indexes(v["cat_index_columns"]))


SELECTIVITY = "((stat_value * 20000 + n_rows) // (2 * n_rows)) / 100.0::DOUBLE"


@check("idx_03_low_cardinality", topk(
    f"{K}, table_schema, table_name, index_name, stat_name, stat_value, n_rows, {SELECTIVITY} AS selectivity_pct",
    "{cat_index_stats} JOIN {cat_table_stats} USING (cluster_id, snapshot_date, node_ip, table_schema, table_name)",
    f"{USER} AND index_name <> 'PRIMARY' AND stat_name LIKE 'n_diff_pfx%' AND n_rows > 1000 AND stat_value > 0 AND {SELECTIVITY} < 10",
    f"{SELECTIVITY}, table_schema, table_name, index_name, stat_name", 50))
def _(v):
    return plain(C.low_cardinality(v["cat_index_stats"], v["cat_table_stats"]))


@check("idx_04_full_scanned_tables", topk(
    f"{K}, table_schema, table_name, count_read AS rows_full_scanned, latency_us", "{index_usage}", "index_name IS NULL AND count_read > 0",
    "count_read DESC, table_schema, table_name", 20))
def _(v):
    return plain(C.full_scanned_tables(v["index_usage"]))


