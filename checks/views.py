"""Telemetry views over the test tables, in SQL that means the same in Spark and DuckDB.

Views that repeat each row a fixed number of times have one text per engine:
Spark explodes a literal array, DuckDB joins literal values.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvitals.functions.once import made_once
BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
DATE = "DATE '2024-01-31'"
GIB = 1073741824


def ip(prefix: str, key: str) -> str:
    """An address made from a number; distinct for numbers below 2^24."""
    high = f"CAST(floor(CAST({key} AS DOUBLE) / 65536) AS BIGINT) % 256"
    middle = f"CAST(floor(CAST({key} AS DOUBLE) / 256) AS BIGINT) % 256"
    parts = [f"CAST({high} AS STRING)", f"CAST({middle} AS STRING)", f"CAST({key} % 256 AS STRING)"]
    return f"concat('{prefix}.', " + ", '.', ".join(parts) + ")"


def text(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


def keys(cluster: str, node: str) -> str:
    return f"CAST({cluster} AS BIGINT) AS cluster_id, {DATE} AS snapshot_date, {node} AS node_ip"


# Parameters of a node; each is a column v_<name> of the nodes view.
VARIABLES = {
    "sync_binlog": f"CASE WHEN s.s_nationkey % 4 = 0 THEN '0' ELSE {text('k % 2')} END",
    "innodb_flush_log_at_trx_commit": f"CASE WHEN s.s_nationkey % 4 = 0 THEN '0' ELSE {text('k % 3')} END",
    "read_only": "CASE WHEN k % 6 = 0 THEN '0' WHEN is_first AND k % 5 <> 0 THEN '0' ELSE '1' END",
    "max_connections": "CASE WHEN k % 4 = 0 THEN '4000' ELSE '1000' END",
    "expire_logs_days": "CASE WHEN k % 9 = 0 THEN '0' WHEN k % 9 = 1 THEN '45' ELSE '7' END",
    "gtid_mode": "CASE WHEN k % 8 = 0 THEN 'OFF' ELSE 'ON' END",
    "long_query_time": "CASE WHEN k % 10 = 0 THEN '10' WHEN k % 10 = 1 THEN '0.5' ELSE '1' END",
    "binlog_format": "CASE WHEN k % 14 = 3 THEN 'MIXED' ELSE 'ROW' END",
    "slow_query_log": "CASE WHEN k % 12 = 5 THEN '0' ELSE '1' END",
    "innodb_buffer_pool_size_in_mb": "CASE k % 3 WHEN 0 THEN '1024' WHEN 1 THEN '9830' ELSE '57344' END",
    "innodb_log_file_size_in_mb": "CASE k % 4 WHEN 0 THEN '48' WHEN 1 THEN '256' WHEN 2 THEN '512' ELSE '1024' END",
    "innodb_flush_method": "CASE k % 5 WHEN 0 THEN 'fsync' WHEN 1 THEN 'O_DIRECT_NO_FSYNC' ELSE 'O_DIRECT' END",
    "innodb_doublewrite": "CASE k % 13 WHEN 0 THEN 'OFF' WHEN 1 THEN '0' ELSE 'ON' END",
    "innodb_temp_data_file_path":
        "CASE WHEN k % 3 = 0 THEN 'ibtmp1:12M:autoextend' ELSE 'ibtmp1:12M:autoextend:max:50G' END",
    "character_set_server": "CASE k % 7 WHEN 0 THEN 'latin1' WHEN 1 THEN 'utf8' ELSE 'utf8mb4' END",
    "default_authentication_plugin":
        "CASE WHEN k % 2 = 0 THEN 'mysql_native_password' ELSE 'caching_sha2_password' END",
    "performance_schema": "CASE WHEN k % 15 = 4 THEN 'OFF' ELSE 'ON' END",
    "slave_skip_errors": "CASE k % 16 WHEN 0 THEN '1062' WHEN 1 THEN 'OFF' ELSE NULL END",
    "slave_parallel_workers": "CASE WHEN k % 2 = 0 THEN '0' ELSE '8' END",
    "lower_case_table_names": "CASE WHEN k % 5 = 2 THEN '0' ELSE '1' END",
    "log_bin": "CASE WHEN k % 5 = 3 THEN 'OFF' ELSE 'mysql-bin' END",
    "wait_timeout": "'28800'",
    "server_id": text("k"),
    "sort_buffer_size_in_kb": "'256'",
    "join_buffer_size_in_kb": "'256'",
    "read_buffer_size_in_kb": "'128'",
    "read_rnd_buffer_size_in_kb": "'384'",
    "tmp_table_size_in_mb": "CASE WHEN k % 3 = 1 THEN '16' ELSE '4' END",
    "transaction_isolation": "CASE WHEN k % 20 = 7 THEN 'REPEATABLE-READ' ELSE 'READ-COMMITTED' END",
    "log_queries_not_using_indexes": "CASE WHEN k % 7 = 2 THEN 'ON' ELSE 'OFF' END",
    "enforce_gtid_consistency": "'ON'",
    "slave_net_timeout": "'60'",
}

_NODE_IP = ip("10", "k")
_NODES = f"""
SELECT {keys('s.s_nationkey', _NODE_IP)}, k,
  CASE WHEN k % 7 = 0 THEN concat('dr-db', {text('k')}) WHEN k % 11 = 1 THEN concat('db-replica', {text('k')})
       ELSE concat('db', {text('k')}) END AS hostname,
  concat('HealthCheck_', {_NODE_IP}, '_202401310100.txt') AS file_name,
  CASE WHEN is_first THEN 'primary' WHEN k % 7 = 0 THEN 'dr' ELSE 'slave' END AS role,
  CASE WHEN is_first THEN 'standalone_readonly' ELSE 'replica' END AS role_source,
  concat(CASE WHEN is_first THEN '0|' ELSE '1|' END, '010.',
    lpad(CAST(CAST(floor(CAST(k AS DOUBLE) / 65536) AS BIGINT) % 256 AS STRING), 3, '0'), '.',
    lpad(CAST(CAST(floor(CAST(k AS DOUBLE) / 256) AS BIGINT) % 256 AS STRING), 3, '0'), '.',
    lpad({text('k % 256')}, 3, '0')) AS node_order,
  NOT is_first AND k % 13 <> 0 AS is_replica,
  k % 17 = 0 AS is_residue,
  CASE WHEN k % 17 = 0 THEN {_NODE_IP} WHEN k % 18 = 1 THEN concat('DB', {text('k')}) ELSE '10.9.9.9' END AS master_host,
  CAST(CASE WHEN is_first AND k % 3 = 0 THEN 2 ELSE NULL END AS BIGINT) AS connected_replicas,
  is_first AND k % 4 = 1 AS has_dump_session,
  CASE WHEN k % 19 = 0 THEN 'No' ELSE 'Yes' END AS io_running,
  CASE WHEN k % 23 = 1 THEN 'No' ELSE 'Yes' END AS sql_running,
  CAST((k % 40) * 25 AS BIGINT) AS lag_seconds,
  CASE WHEN k % 9 = 0 THEN 'FreeBSD 13' ELSE 'Linux 3.10.0-1160.el7' END AS os_kernel,
  CASE k % 6 WHEN 0 THEN 'CentOS release 6.9 (Final)' WHEN 1 THEN 'CentOS Linux release 7.9.2009 (Core)'
    WHEN 2 THEN 'CentOS Linux 8' WHEN 3 THEN 'Rocky Linux 9.3' WHEN 4 THEN '' ELSE 'Ubuntu 22.04' END AS os_release,
  CASE k % 9 WHEN 0 THEN '5.5.60-log' WHEN 1 THEN '5.6.40' WHEN 2 THEN '5.7.30-log' WHEN 3 THEN '8.0.35' WHEN 4 THEN '8.4.1'
    WHEN 5 THEN '9.0.1' WHEN 6 THEN '10.5.2-MariaDB' WHEN 7 THEN '11.2.1' ELSE '-' END AS server_version,
  CAST(16 + k % 3 * 16 AS BIGINT) AS cpu_cores, 'Xeon' AS cpu_model,
  CAST(NULLIF((k * 37) % 60, 0) * 86400 AS BIGINT) AS uptime_sec,
  CAST((k * 29) % 1200 AS BIGINT) AS threads_connected,
  CAST(1000000 + k * 1000 AS BIGINT) AS questions,
  CAST((k * 31) % 40 * 50000 AS BIGINT) AS slow_queries,
  CAST((k * 13) % 1500 AS DOUBLE) AS qps,
  CAST(CASE WHEN k % 5 = 0 THEN 16 ELSE 64 END AS BIGINT) * 1048576 AS mem_total_kb,
  CAST(60 + (k * 7) % 40 AS DOUBLE) AS mem_pct,
  CAST(4194304 AS BIGINT) AS swap_total_kb,
  CAST((k % 4) * 1048576 AS BIGINT) AS swap_used_kb,
  CAST((k % 4) * 25 AS DOUBLE) AS swap_pct,
  CAST((k * 17) % 90 * 1000 AS BIGINT) AS history_list,
  CAST(900 + k % 101 AS BIGINT) AS bp_hits, CAST(1000 AS BIGINT) AS bp_lookups,
  CASE WHEN k % 10 = 9 THEN NULL ELSE CAST((k * 11) % 12 AS BIGINT) * {GIB} END AS temp_bytes,
  k % 20 <> 9 AS temp_collected,
  CAST((k * 23) % 800 AS DOUBLE) AS db_total_gb,
  CAST((k * 5) % 80 AS BIGINT) * {GIB} AS binlog_bytes,
  CAST((k * 3) % 9 AS BIGINT) * {GIB} AS slow_log_bytes,
  CAST(k % 5 AS BIGINT) * 52428800 AS error_log_bytes,
  CAST(k % 3 AS BIGINT) * {GIB} AS relay_bytes,
  CAST((k * 23) % 300 AS BIGINT) * {GIB} AS data_bytes,
  CAST((k * 7) % 90 AS BIGINT) AS error_count, CAST((k * 11) % 60 AS BIGINT) AS warning_count,
  CAST(50 + (k * 7) % 50 AS BIGINT) AS root_pct, CAST(50 + (k * 11) % 50 AS BIGINT) AS data_pct,
  CASE k % 4 WHEN 0 THEN 'NO_ENGINE_SUBSTITUTION' WHEN 1 THEN 'STRICT_TRANS_TABLES,NO_ZERO_DATE'
    WHEN 2 THEN 'ANSI,STRICT_ALL_TABLES' ELSE NULL END AS sql_mode,
  CASE WHEN k % 6 = 5 THEN NULL WHEN k % 3 = 0 THEN 'DISABLED' ELSE 'YES' END AS have_ssl,
  CASE WHEN k % 6 = 5 THEN NULL WHEN k % 4 = 0 THEN 'TLSv1,TLSv1.1,TLSv1.2' WHEN k % 4 = 1 THEN 'TLSv1.2,TLSv1.3' ELSE '' END AS tls_version,
  CASE WHEN k % 6 = 5 THEN NULL WHEN k % 5 = 1 THEN 'ON' ELSE 'OFF' END AS require_secure,
  CASE WHEN k % 5 = 1 THEN NULL ELSE k % 6 = 0 END AS has_audit,
  CASE WHEN k % 7 = 3 THEN NULL ELSE k % 4 = 0 END AS has_password_policy,
  CASE WHEN k % 5 = 2 THEN NULL ELSE k % 9 = 0 END AS has_encryption,
  CASE WHEN k % 5 = 2 THEN NULL ELSE k % 3 = 0 END AS has_keyring,
  CASE WHEN k % 5 = 3 THEN NULL ELSE k % 11 = 0 END AS has_empty_password,
  CASE WHEN s.s_nationkey % 3 = 0 THEN NULL ELSE k % 8 = 0 END AS has_old_auth,
  CASE WHEN s.s_nationkey % 3 = 1 THEN NULL ELSE k % 12 = 0 END AS has_login_failures,
  CAST(5 AS BIGINT) AS n_users,
  CAST(CASE WHEN s.s_nationkey % 5 = 0 THEN 1 ELSE k % 2 END AS BIGINT) AS n_root_open,
  CAST((k * 19) % 100 AS DOUBLE) / 100 AS max_auto_rate,
  {", ".join(f"{e} AS v_{n}" for n, e in VARIABLES.items())}
FROM (SELECT x.*, CAST(x.s_suppkey AS BIGINT) AS k, x.s_suppkey = f.first_key AS is_first FROM {{supplier}} x
  JOIN (SELECT s_nationkey AS nk, min(s_suppkey) AS first_key FROM {{supplier}} GROUP BY s_nationkey) f
  ON x.s_nationkey = f.nk) s
"""

_CATALOG_KEYS = keys("p_size % 25", "concat('172.16.0.', CAST(p_size % 25 AS STRING))")
_SCHEMA = "CASE WHEN p_partkey % 45 = 0 THEN 'mysql' ELSE lower(p_type) END"
_TABLE_NAME = f"""concat(CASE WHEN p_partkey % 23 = 0 THEN '_gho_' ELSE '' END, replace(p_name, ' ', '_'), '_t', {text('p_partkey')},
    CASE WHEN p_partkey % 11 = 0 THEN '_20240115' WHEN p_partkey % 13 = 0 THEN '_bak' WHEN p_partkey % 17 = 0 THEN '_tmp' ELSE '' END)"""
_TABLE = f"{_CATALOG_KEYS}, {_SCHEMA} AS table_schema, {_TABLE_NAME} AS table_name, p_partkey AS k"

SHARED: dict[str, str] = {
    "nodes": _NODES,
    "cat_tables": f"""
SELECT {_TABLE},
  CASE WHEN p_partkey % 50 = 0 THEN 'MyISAM' ELSE 'InnoDB' END AS engine,
  CASE WHEN p_partkey % 12 = 0 THEN 'latin1_swedish_ci' ELSE 'utf8mb4_general_ci' END AS table_collation,
  CASE WHEN p_partkey % 40 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type,
  CAST(p_size AS BIGINT) * 1000 AS table_rows, CAST(p_size AS BIGINT) * 104857600 AS data_length,
  CAST(p_partkey % 40 AS BIGINT) * 10485760 AS index_length, CAST(p_partkey % 97 AS BIGINT) * 104857600 AS data_free,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST((p_partkey * 1000003) % 2147483647 AS BIGINT) END AS auto_increment
FROM {{part}}""",
    "cat_schemata": """
SELECT DISTINCT cluster_id, snapshot_date, node_ip, table_schema AS schema_name,
  CASE WHEN length(table_schema) % 2 = 0 THEN 'utf8mb4' ELSE 'latin1' END AS charset,
  CASE WHEN length(table_schema) % 2 = 0 THEN 'utf8mb4_general_ci' ELSE 'latin1_swedish_ci' END AS schema_collation
FROM {cat_tables}
UNION ALL SELECT DISTINCT cluster_id, snapshot_date, node_ip, 'empty_db' AS schema_name, 'utf8mb4' AS charset, 'utf8mb4_bin' AS schema_collation
FROM {cat_tables}""",
    "cat_events": "SELECT cluster_id, snapshot_date, node_ip, table_schema AS event_schema, k FROM {cat_tables}",
    "cat_triggers": "SELECT cluster_id, snapshot_date, node_ip, table_schema AS trigger_schema, k FROM {cat_tables}",
    "cat_routines": f"""
SELECT cluster_id, snapshot_date, node_ip, table_schema AS routine_schema, concat('r', {text('k')}) AS routine_name,
  CASE WHEN k % 2 = 0 THEN 'PROCEDURE' ELSE 'FUNCTION' END AS routine_type, 'dba@localhost' AS definer
FROM {{cat_tables}}""",
    "cat_table_stats": """
SELECT cluster_id, snapshot_date, node_ip, table_schema, table_name, table_rows AS n_rows FROM {cat_tables}""",
    "cat_engines": """
SELECT DISTINCT cluster_id, snapshot_date, node_ip, engine, CASE engine WHEN 'InnoDB' THEN 'DEFAULT' ELSE 'YES' END AS support
FROM {cat_tables}""",
    "cat_files": f"""
SELECT cluster_id, snapshot_date, node_ip, CASE WHEN k % 7 = 0 THEN './ibtmp1' WHEN k % 7 = 1 THEN 'innodb_temporary' ELSE table_name END AS name,
  data_length AS file_size, data_length + 4096 AS allocated_size, CAST(67108864 AS BIGINT) AS autoextend_size
FROM {{cat_tables}}""",
    "cat_users": f"""
SELECT {keys('c_nationkey', "concat('172.16.0.', CAST(c_nationkey AS STRING))")}, c_custkey AS k,
  CASE WHEN c_custkey % 60 = 0 THEN 'root' ELSE concat(CASE c_mktsegment WHEN 'BUILDING' THEN 'app' WHEN 'MACHINERY' THEN 'backup'
    WHEN 'FURNITURE' THEN 'ro' WHEN 'HOUSEHOLD' THEN 'repl' ELSE 'admin' END, {text('c_custkey % 10')}) END AS user_name,
  CASE WHEN c_custkey % 4 = 0 THEN '%' ELSE '10.0.0.%' END AS host,
  CASE WHEN c_custkey % 5 = 0 THEN 'mysql_native_password' ELSE 'caching_sha2_password' END AS plugin,
  DATE '2023-01-01' + CAST(c_custkey % 400 AS INT) AS password_last_changed,
  CAST(CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 180 ELSE 365 END AS BIGINT) AS password_lifetime,
  CASE WHEN c_custkey % 6 = 0 THEN 'Y' ELSE 'N' END AS super_priv,
  CASE WHEN c_custkey % 2 = 0 THEN 'Y' ELSE 'N' END AS select_priv
FROM {{customer}}""",
    "host_stats": f"""
SELECT {keys('c_nationkey', "concat('172.16.0.', CAST(c_nationkey AS STRING))")}, {ip('192', 'c_custkey')} AS ip, {ip('192', 'c_custkey')} AS host,
  CAST(c_custkey % 50 AS BIGINT) AS current_connections, CAST((c_custkey * 17) % 9973 AS BIGINT) AS total_connections,
  CAST((c_custkey * 7) % 301 AS BIGINT) AS connect_errors, CAST(c_custkey % 11 AS BIGINT) AS handshake_errors,
  CAST(c_custkey % 13 AS BIGINT) AS auth_errors
FROM {{customer}}""",
    "sessions": f"""
SELECT {keys('user_id % 25', ip('10', 'user_id'))}, CAST(event_id AS BIGINT) AS session_id,
  CASE WHEN event_id % 29 = 0 THEN 'system user' WHEN event_id % 31 = 0 THEN 'event_scheduler' WHEN event_id % 37 = 0 THEN 'repl'
    ELSE concat('app', {text('user_id % 9')}) END AS user_name,
  concat('10.0.', {text('user_id % 20')}, '.5:', {text('event_id')}) AS host,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('db', {text('event_id % 3')}) END AS db,
  CASE event_type WHEN 'view' THEN 'Sleep' WHEN 'click' THEN 'Query' WHEN 'error' THEN 'Connect'
    WHEN 'purchase' THEN 'Binlog Dump' ELSE 'Execute' END AS command,
  CAST(floor(value * 20) AS BIGINT) AS time_s,
  CASE WHEN event_id % 41 = 0 THEN 'Waiting for master to send event' WHEN event_id % 43 = 0 THEN 'Waiting on empty queue' ELSE 'Sending data' END AS state
FROM {{events}}""",
    "threads": f"""
SELECT {keys('user_id % 25', ip('10', 'user_id'))}, CAST(event_id AS BIGINT) AS thread_id,
  CASE WHEN event_id % 17 = 0 THEN 'thread/sql/slave_io' WHEN event_id % 17 = 1 THEN 'thread/sql/replica_sql' ELSE 'thread/sql/one_connection' END AS name,
  CASE WHEN event_id % 5 = 0 THEN 'BACKGROUND' ELSE 'FOREGROUND' END AS type,
  CASE event_type WHEN 'view' THEN 'Sleep' WHEN 'purchase' THEN 'Binlog Dump' ELSE 'Query' END AS command, 'running' AS state
FROM {{events}}""",
    "open_tables": f"""
SELECT {keys('user_id % 25', ip('10', 'user_id'))}, concat('db', {text('event_id % 3')}) AS table_schema,
  concat('t', {text('event_id')}) AS table_name, CAST(event_id % 4 AS BIGINT) AS in_use
FROM {{events}}""",
    "trx": f"""
SELECT {keys('o_custkey % 25', "concat('172.16.0.', CAST(o_custkey % 25 AS STRING))")}, concat('T', {text('o_orderkey')}) AS trx_id,
  CAST(o_orderkey % 5000 AS BIGINT) AS thread_id, concat('UPDATE t SET a = ', {text('o_orderkey')}) AS query
FROM {{orders}}""",
    "lock_wait_rows": f"""
SELECT {keys('o_custkey % 25', "concat('172.16.0.', CAST(o_custkey % 25 AS STRING))")}, concat('T', {text('o_orderkey')}) AS waiting_trx_id,
  concat('T', {text('o_orderkey - 25')}) AS blocking_trx_id
FROM {{orders}}""",
    "digests": f"""
SELECT {keys('l_suppkey % 25', "concat('172.16.0.', CAST(l_suppkey % 25 AS STRING))")}, concat('d', {text('l_partkey % 300')}) AS digest,
  CASE WHEN l_partkey % 300 = 7 THEN 'mysql' WHEN l_partkey % 300 = 8 THEN NULL ELSE concat('db', {text('l_partkey % 4')}) END AS db,
  CASE WHEN l_partkey % 300 = 9 THEN 'SHOW TABLES' ELSE concat('SELECT * FROM t', {text('l_partkey % 300')}) END AS query,
  CAST(count(*) AS BIGINT) AS exec_count,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total_us,
  CAST(max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS max_us,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS rows_examined,
  CAST(sum(CAST(l_linenumber - 1 AS BIGINT)) AS BIGINT) AS rows_sent,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS no_index,
  CAST(sum(CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN 1 ELSE 0 END) AS BIGINT) AS no_good_index,
  CAST(sum(CASE WHEN l_returnflag = 'A' THEN 2 ELSE 0 END) AS BIGINT) AS tmp_tables,
  CAST(sum(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS tmp_disk,
  CAST(sum(CASE WHEN l_linenumber > 4 THEN l_linenumber ELSE 0 END) AS BIGINT) AS sort_rows,
  CAST(sum(CASE WHEN l_linenumber > 5 THEN 1 ELSE 0 END) AS BIGINT) AS sort_merges,
  CAST(sum(CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  CAST(sum(CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) AS BIGINT) AS warnings
FROM {{lineitem}} GROUP BY l_suppkey % 25, l_partkey % 300, l_partkey % 4""",
    "statements": f"""
SELECT {keys('l_suppkey % 25', "concat('172.16.0.', CAST(l_suppkey % 25 AS STRING))")}, concat('db', {text('l_linenumber % 3')}) AS db,
  concat('SELECT  * FROM t', {text('l_linenumber')}, ' WHERE id = ', {text('l_partkey')}, ' AND flag = ''', l_returnflag, '''') AS sql,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS latency_us, CAST(l_quantity AS BIGINT) AS rows_examined,
  CAST(l_linenumber AS BIGINT) AS rows_sent, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) AS no_index,
  CAST(l_shipdate AS DATE) AS seen_at
FROM {{lineitem}}""",
    "backup_files": f"""
SELECT {keys('o_custkey % 25', ip('10', 'o_custkey % 100'))}, '/data/backup' AS dir,
  concat('/data/backup/full_', {text('o_orderkey')}, '.sql') AS path, CAST(o_orderdate AS DATE) AS mtime,
  CAST(round(o_totalprice * 100) AS BIGINT) AS bytes
FROM {{orders}}""",
    "backup_dirs": f"""
SELECT {keys('s_nationkey', ip('10', 's_suppkey'))}, CASE WHEN s_suppkey % 3 = 0 THEN '/opt/db_bak/' ELSE '/data/backup' END AS path,
  s_suppkey % 5 <> 0 AS "exists", '10G' AS total_size, CAST(CASE WHEN s_nationkey % 6 = 1 THEN 0 ELSE s_suppkey % 4 END AS BIGINT) AS n_files
FROM {{supplier}}""",
    "cron_lines": f"""
SELECT {keys('s_nationkey', ip('10', 's_suppkey'))}, 'root' AS source,
  CASE WHEN s_nationkey % 4 = 1 THEN concat('0 1 * * * /usr/bin/rotate', {text('s_suppkey')})
       ELSE concat('0 3 * * * /bin/sh /opt/jobs', {text('s_suppkey % 7')}, '/xtrabackup_full.sh > /var/dump/log', {text('s_suppkey % 3')}, '/') END AS line
FROM {{supplier}}""",
}

# Views that repeat rows: (source, select list, literal columns, literal rows, filter).
REPEATED: dict[str, tuple[str, str, list[str], list[tuple], str]] = {
    "disks": (
        "nodes",
        "cluster_id, snapshot_date, node_ip, i.mount AS mount, CASE i.mount WHEN '/' THEN root_pct ELSE data_pct END AS use_pct",
        ["mount"],
        [("/",), ("/data",)],
        "TRUE",
    ),
    "variables": (
        "nodes",
        "cluster_id, snapshot_date, node_ip, i.name AS name, CASE i.name "
        + " ".join(f"WHEN '{n}' THEN v_{n}" for n in VARIABLES)
        + " END AS value",
        ["name"],
        [(n,) for n in VARIABLES],
        "CASE i.name " + " ".join(f"WHEN '{n}' THEN v_{n}" for n in VARIABLES) + " END IS NOT NULL",
    ),
    "backup_tools": (
        "nodes",
        "cluster_id, snapshot_date, node_ip, i.tool AS tool, "
        "(k + i.n) % 3 = 0 AND cluster_id % 5 <> 2 AS installed, concat('/usr/bin/', CAST(k AS STRING)) AS detail",
        ["tool", "n"],
        [("mysqldump", 0), ("xtrabackup", 1), ("mydumper", 2)],
        "TRUE",
    ),
    "databases": (
        "nodes",
        "cluster_id, snapshot_date, node_ip, i.name AS name",
        ["name", "n"],
        [("shop", 0), ("pay", 3), ("log", 4), ("tmp", 5)],
        "i.n = 0 OR (k % i.n) <> 1",
    ),
    "status": (
        "nodes",
        "cluster_id, snapshot_date, node_ip, i.name AS name, CAST((k * i.n) % 1009 AS STRING) AS value",
        ["name", "n"],
        [("Connections", 3), ("Questions", 5), ("Innodb_row_lock_current_waits", 7), ("Innodb_row_lock_waits", 11),
         ("Innodb_row_lock_time_avg", 13), ("Table_locks_waited", 17), ("Bytes_sent", 19), ("Ssl_version", 23),
         ("Rpl_semi_sync_master_status", 29), ("Rpl_semi_sync_slave_status", 31)],
        "TRUE",
    ),
    "engine_counters": (
        "nodes",
        "cluster_id, snapshot_date, node_ip, concat(i.subsystem, '_', CAST(i.n AS STRING)) AS name, CAST((k * i.n) % 1013 AS BIGINT) AS metric_count, "
        "i.subsystem AS subsystem, CASE WHEN (k + i.n) % 4 = 0 THEN 'disabled' ELSE 'enabled' END AS status",
        ["subsystem", "n"],
        [(s, n) for s in ("buffer", "lock", "log", "server", "index") for n in range(1, 25)],
        "TRUE",
    ),
    "buffer_pools": (
        "nodes",
        "cluster_id, snapshot_date, node_ip, CAST(i.n AS BIGINT) AS pool_id, CAST(8192 AS BIGINT) AS pool_size, "
        "CAST(k % 100 + i.n AS BIGINT) AS free_buffers, CAST(8000 - k % 100 AS BIGINT) AS database_pages, "
        "CAST((k * i.n) % 50 AS BIGINT) AS modified_database_pages, CAST(900 + (k + i.n) % 100 AS DOUBLE) AS hit_rate",
        ["n"],
        [(1,), (2,), (3,), (4,)],
        "TRUE",
    ),
    "binlogs": (
        "nodes",
        "cluster_id, snapshot_date, node_ip, concat('mysql-bin.00000', CAST(i.n AS STRING)) AS log_name, CAST((k % 7 + i.n) * 1000 AS BIGINT) AS file_size",
        ["n"],
        [(1,), (2,), (3,)],
        "i.n <= 1 + k % 3",
    ),
    "applier_workers": (
        "nodes",
        "cluster_id, snapshot_date, node_ip, 'main' AS channel, CAST(i.n AS BIGINT) AS worker_id, "
        "CASE WHEN (k + i.n) % 9 = 0 THEN 'OFF' ELSE 'ON' END AS service_state, CAST(CASE WHEN (k + i.n) % 11 = 0 THEN 1032 ELSE 0 END AS BIGINT) AS last_error_number",
        ["n"],
        [(1,), (2,), (3,), (4,)],
        "is_replica",
    ),
    "cat_columns": (
        "cat_tables",
        "cluster_id, snapshot_date, node_ip, table_schema, table_name, i.name AS column_name, "
        "CASE WHEN i.name = 'id' AND k % 4 = 0 THEN 'bigint' WHEN i.name = 'body' AND k % 5 = 0 THEN 'longtext' WHEN i.name = 'extra' AND k % 6 = 0 THEN 'json' ELSE i.kind END AS data_type, "
        "CASE WHEN i.name = 'id' AND k % 2 = 0 THEN 'int(10) unsigned' ELSE i.kind END AS column_type, "
        "CASE WHEN i.name = 'id' THEN 'auto_increment' ELSE '' END AS extra",
        ["name", "kind"],
        [("id", "int"), ("body", "varchar"), ("extra", "text"), ("note", "varchar")],
        "NOT (i.name = 'extra' AND k % 7 = 0)",
    ),
    "cat_partitions": (
        "cat_tables",
        "cluster_id, snapshot_date, node_ip, table_schema, table_name, concat('p', CAST(i.n AS STRING)) AS partition_name",
        ["n"],
        [(0,), (1,), (2,), (3,)],
        "i.n <= k % 4",
    ),
    "cat_index_columns": (
        "cat_tables",
        "cluster_id, snapshot_date, node_ip, table_schema, table_name, i.index_name AS index_name, CAST(i.seq AS BIGINT) AS seq, i.col AS col, CAST(i.nu AS BIGINT) AS non_unique",
        ["index_name", "seq", "col", "nu"],
        [("PRIMARY", 1, "id", 0), ("ix_a", 1, "a", 1), ("ix_ab", 1, "a", 1), ("ix_ab", 2, "b", 1), ("ix_c", 1, "c", 1), ("ux_c", 1, "c", 0)],
        "NOT (i.index_name = 'PRIMARY' AND k % 6 = 0) AND NOT (i.index_name = 'ix_ab' AND k % 4 = 0) AND NOT (i.index_name = 'ux_c' AND k % 3 <> 0)",
    ),
    "cat_index_stats": (
        "cat_tables",
        "cluster_id, snapshot_date, node_ip, table_schema, table_name, i.index_name AS index_name, i.stat AS stat_name, "
        "CASE i.stat WHEN 'size' THEN CAST((k * i.f) % 5003 AS BIGINT) ELSE CAST((k * i.f) % 3001 AS BIGINT) END AS stat_value",
        ["index_name", "stat", "f"],
        [("PRIMARY", "size", 1), ("ix_a", "size", 7), ("ix_ab", "size", 11), ("ix_c", "size", 13),
         ("PRIMARY", "n_diff_pfx01", 3), ("ix_a", "n_diff_pfx01", 5), ("ix_c", "n_diff_pfx01", 17)],
        "TRUE",
    ),
    "index_usage": (
        "cat_tables",
        "cluster_id, snapshot_date, node_ip, table_schema, table_name, NULLIF(i.index_name, '-') AS index_name, CAST(i.nu AS BIGINT) AS non_unique, "
        "CASE WHEN (k + i.f) % 3 = 0 THEN CAST(0 AS BIGINT) ELSE CAST((k * i.f) % 977 AS BIGINT) END AS count_star, "
        "CASE WHEN (k + i.f) % 5 = 0 THEN CAST(0 AS BIGINT) ELSE CAST((k * i.f) % 983 AS BIGINT) END AS count_read, CAST((k * i.f) % 991 AS BIGINT) AS latency_us",
        ["index_name", "nu", "f"],
        [("PRIMARY", 0, 1), ("ix_a", 1, 2), ("ix_c", 1, 4), ("ux_c", 0, 5), ("-", 1, 7)],
        "TRUE",
    ),
}

NAMES = [*SHARED, *REPEATED]


def _literal(value) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value)


def _spark_repeated(name: str) -> str:
    source, select, columns, rows, where = REPEATED[name]
    structs = ", ".join(
        "named_struct(" + ", ".join(f"'{c}', {_literal(v)}" for c, v in zip(columns, row)) + ")" for row in rows
    )
    return f"SELECT {select} FROM {{{source}}} LATERAL VIEW explode(array({structs})) e AS i WHERE {where}"


def _duck_repeated(name: str) -> str:
    source, select, columns, rows, where = REPEATED[name]
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"SELECT {select} FROM {{{source}}} CROSS JOIN (VALUES {values}) i({', '.join(columns)}) WHERE {where}"


def _references(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w+)\}", sql)))


class Views:
    """The views as Spark DataFrames over one directory of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in BASE_TABLES:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = SHARED[name] if name in SHARED else _spark_repeated(name)
                sql = sql.replace('"exists"', "`exists`")
                self.made[name] = self.spark.sql(sql, **{r: self[r] for r in _references(sql)})
        return self.made[name]

    def node_facts(self) -> DataFrame:
        """The nodes view in the shape of parsed dumps: maps and arrays instead of flat columns."""
        nodes = self["nodes"]
        flat = [c for c in nodes.columns if not c.startswith("v_") and c not in ("root_pct", "data_pct", "have_ssl", "tls_version", "require_secure")]
        return nodes.select(*flat, *_nested_facts())


@made_once
def _nested_facts() -> list:
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"v_{n}").alias("v")) for n in VARIABLES])
    variables = F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull()))
    mounts = F.array(
        *[F.struct(F.lit(m).alias("mount"), F.col(c).alias("use_pct")) for m, c in (("/", "root_pct"), ("/data", "data_pct"))]
    )
    tls = F.when(
        F.col("have_ssl").isNotNull(),
        F.create_map(
            F.lit("have_ssl"), F.col("have_ssl"), F.lit("tls_version"), F.col("tls_version"),
            F.lit("require_secure_transport"), F.col("require_secure"),
        ),
    )
    return [variables.alias("variables"), mounts.alias("disks"), tls.alias("tls_config")]


def with_views(sql: str) -> str:
    """A DuckDB query whose {view} references are resolved by common table expressions."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in BASE_TABLES or name in needed:
            return
        body = SHARED[name] if name in SHARED else _duck_repeated(name)
        for r in _references(body):
            visit(r)
        needed.append(name)

    for r in _references(sql):
        visit(r)
    parts = []
    for name in needed:
        body = SHARED[name] if name in SHARED else _duck_repeated(name)
        parts.append(f"{name} AS ({_plain(body)})")
    body = _plain(sql).strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def _plain(sql: str) -> str:
    return re.sub(r"\{([a-z]\w+)\}", r"\1", sql)
