"""Word lists, patterns, lookup rows and formats that results depend on.

Everything in this file is a constant of the input format or of the health
rules. Nothing here is logic; the operators decide what to do with it.
"""

# Dump file format.
DUMP_FILE_PATTERN = r"(?i)^\w*HealthCheck_.*\.txt$"
SECTION_MARKER = "----->>>---->>>"
TOTAL_SIZE_LABEL = "总大小"
MISSING_LABEL = "不存在"
UNAVAILABLE_PATTERN = "不可读|未启用"
NOT_ENABLED_PATTERN = "未启用"
DATABASE_TOTAL_LABEL = "DATABASE TOTAL SIZE"

# Schemas that belong to the server itself.
SYSTEM_SCHEMAS = ["mysql", "sys", "information_schema", "performance_schema"]

# File-size units, 1024-based.
SIZE_PATTERN = r"(?i)^([\d.]+)\s*([KMGT])?B?$"

# Role hints in host or file names.
PRIMARY_HINT = r"pri|master|primary"
DR_HINT = r"^dr[-_]|[-_]dr[-_]|disaster|standby|backup[-_]?(mysql|db)"
REPLICA_HINT = r"slave|replica"
DR_ANYWHERE_HINT = r"(?i)\bdr[-_]|disaster|standby"

# Statements that are metadata or session control, not business SQL.
METADATA_VERB = r"(?i)^(SHOW|DESC|DESCRIBE|EXPLAIN)\s"
METADATA_SCHEMA = r"(?i)\b(information_schema|performance_schema|mysql\.|sys\.)"
METADATA_PROBE = (
    r"(?i)^SELECT\s+(NOW|SYSTEM_USER|VERSION|DATABASE|USER|CURRENT_USER|CONNECTION_ID)\s*\("
)
SESSION_VERB = r"(?i)^(SET|USE|RESET)\s"
TRANSACTION_VERB = r"(?i)^(COMMIT|ROLLBACK|BEGIN|START\s+TRANSACTION)\s*$"

# Table names that are temporary, historic, backup or tool tables.
TEMP_OR_HISTORY_PATTERNS = [
    r"(?i)^[a-z]{1,3}\d{0,2}$",
    r"(?i)^test\d*$",
    r"(?i)^t_(year|month|day|date|hour|minute|second|calendar|bit|byte)([_0-9]|$)",
    r"(?i)^(calendar|dim_date|dim_time|date_dim|time_dim|nums|numbers|sequence)$",
    r"(?i)^tmp[_0-9]|^temp[_0-9]|^test[_0-9]",
    r"(?i)_tmp\d*$|_temp\d*$|_test\d*$",
    r"(?i)_temp_|_tmp_|_test_",
    r"(?i)_bak$|_bak[_0-9]|_backup$|_backup[_0-9]|_old$|_old[_0-9]",
    r"_\d{8}$|_\d{6}$|_\d{4}-\d{2}",
    r"(?i)^_gho_|^_ghc_|^_(gho|ghc|del)_",
    r"(?i)_(copy|copy\d+|new\d*|old\d*)$",
]

# Leftovers of online schema changes.
GHOST_PATTERNS = [
    r"(?i)^_gho_|^_ghc_|^_(gho|ghc|del)_",
    r"(?i)^_.*_new$|^_.*_old$",
]
GHOST_UNDERSCORE = r"(?i)^_[a-z]"

# Report categories of tables.
CATEGORY_TEMP = r"(?i)^tmp_|^temp_|^test_|_tmp$|_temp$|_test$|tmp|temp|test"
CATEGORY_HISTORY = (
    r"(?i)_bak$|_bak_|_backup$|_old$|_archive$|_his$|_history$|history|archive"
    r"|_\d{8}$|_\d{6}$|_\d{4}-\d{2}|_\d{4}_\d{2}|^_gho_|^_ghc_|^_(gho|ghc|del)_"
)
ARCHIVE_TABLE = r"_\d{8}$|_\d{6}$|_\d{4}_\d{2}$|_\d{4}-\d{2}"

# Account names open to every host, by danger.
ADMIN_ACCOUNT = r"admin|dba|super"
REPLICATION_ACCOUNT = r"replic"
BACKUP_ACCOUNT = r"backup|dump"
MONITOR_ACCOUNT = r"zabbix|prometheus|nagios|monitor|exporter"
READONLY_ACCOUNT = r"^ro|readonly"

# Operating systems out of support: (pattern, name, end of life, priority).
OS_LIFECYCLE = [
    (r"(?i)CentOS(?: Linux)? release 6\b|CentOS Linux 6\b", "CentOS 6", "2020-11-30", "P1"),
    (r"(?i)CentOS(?: Linux)? release 7\b|CentOS Linux 7\b", "CentOS 7", "2024-06-30", "P2"),
    (r"(?i)CentOS(?: Linux)? release 8\b|CentOS Linux 8\b", "CentOS 8", "2021-12-31", "P2"),
]

# Server lifecycles: (version pattern, name, status, date text, priority).
SERVER_LIFECYCLE = [
    (r"^5\.5", "5.5", "eol", "2018-12", "P0"),
    (r"^5\.6", "5.6", "eol", "2021-02", "P0"),
    (r"^5\.7", "5.7", "eol", "2023-10", "P1"),
    (r"^8\.0", "8.0", "security", "2026-04", "P3"),
    (r"^8\.4", "8.4", "supported", "2032-04", None),
    (r"^9\.", "9.x", "supported", None, None),
    (r"^10\.\d", "MariaDB 10.x", "eol", None, "P2"),
    (r"^11\.[0-3]", "MariaDB 11.0-11.3", "eol", None, "P2"),
]

# Protocol versions.
TLS_WEAK = r"(?i)TLSv1(?:[^.\d]|$)|TLSv1\.1"
TLS_STRONG = r"(?i)TLSv1\.[23]"

# Session states of replication and of internal daemons.
REPLICATION_STATE = (
    r"(?i)Waiting for master|Queueing master event|Slave has read all"
    r"|Reading event from the relay log|Has read all relay log"
)
DAEMON_USER = r"(?i)event[_\s]?scheduler"
DAEMON_STATE = r"(?i)waiting on empty queue|waiting for next activation"

# Kernel names that mean Linux.
LINUX_KERNEL = r"(?i)linux|el|centos|ubuntu|debian"

# Backup evidence.
BACKUP_TOOL = r"xtrabackup|mysqldump|mariabackup"
BACKUP_CRON = r"(?i)mysql|backup|dump|xtrabackup"
BACKUP_PATH = r"(?i)backup|bak|dump|xtra|xbstream|maria"

# Data types.
LARGE_TYPES = ["BLOB", "LONGBLOB", "LONGTEXT", "MEDIUMBLOB", "MEDIUMTEXT", "TEXT", "TINYBLOB", "TINYTEXT"]
STANDARD_TYPES = [
    "BIGINT", "CHAR", "DATE", "DATETIME", "DECIMAL", "DOUBLE", "FLOAT",
    "INTEGER", "MEDIUMINT", "SMALLINT", "TIMESTAMP", "TINYINT", "VARCHAR", "INT",
]
INTEGER_BITS = {"tinyint": 7, "smallint": 15, "mediumint": 23, "int": 31, "bigint": 63}

# Engine subsystems and status counters that are reported.
METRIC_SUBSYSTEMS = [
    "buffer", "transaction", "dml", "lock", "adaptive_hash_index", "recovery", "log", "cpu",
]
STATUS_COUNTERS = [
    "Connections", "Uptime", "Com_select", "Com_insert", "Com_update", "Com_delete",
    "Com_commit", "Com_rollback", "Slow_queries", "Created_tmp_tables",
    "Created_tmp_disk_tables", "Created_tmp_files", "Table_locks_waited",
    "Sort_merge_passes", "Sort_range", "Sort_rows", "Sort_scan", "Threads_connected",
    "Threads_running", "Aborted_connects", "Aborted_clients", "Queries", "Questions",
    "Bytes_received", "Bytes_sent",
]

# Parameters compared between nodes.
CONSISTENT_PARAMETERS = [
    "innodb_buffer_pool_size_in_mb", "innodb_log_file_size_in_mb", "max_connections",
    "binlog_format", "expire_logs_days", "long_query_time", "slow_query_log", "wait_timeout",
]
DRIFT_PARAMETERS = [
    "server_version", "server_id", "innodb_buffer_pool_size_in_mb",
    "innodb_log_file_size_in_mb", "max_connections", "binlog_format", "gtid_mode",
    "read_only", "expire_logs_days", "long_query_time", "slow_query_log", "sync_binlog",
    "innodb_flush_log_at_trx_commit", "transaction_isolation", "wait_timeout",
]
REPLICATION_PARAMETERS = [
    "log_bin", "binlog_format", "sync_binlog", "gtid_mode", "enforce_gtid_consistency",
    "slave_parallel_workers", "slave_net_timeout", "expire_logs_days",
]
# Parameter matrix: (name, advice).
MATRIX_PARAMETERS = [
    ("server_version", "same on every node"),
    ("server_id", "unique per node"),
    ("innodb_buffer_pool_size_in_mb", "50-70% of memory"),
    ("innodb_buffer_pool_instances", ">= 8"),
    ("innodb_log_file_size_in_mb", ">= 512 MB"),
    ("innodb_flush_log_at_trx_commit", "1 on the primary"),
    ("sync_binlog", "1 on the primary"),
    ("max_connections", "by business concurrency"),
    ("binlog_format", "ROW"),
    ("gtid_mode", "ON"),
    ("enforce_gtid_consistency", "ON"),
    ("read_only", "primary 0, replicas 1"),
    ("expire_logs_days", "7-15 days"),
    ("long_query_time", "1 s"),
    ("slow_query_log", "ON"),
    ("transaction_isolation", "READ-COMMITTED"),
    ("innodb_flush_method", "O_DIRECT"),
    ("innodb_file_per_table", "1"),
    ("open_files_limit", ">= 65535"),
    ("table_open_cache", "4000-8000"),
    ("default_storage_engine", "InnoDB"),
]

# Scores.
PENALTY = {"P0": 18.0, "P1": 7.0, "P2": 3.0, "P3": 1.0}
DIMENSION_WEIGHTS = {
    "availability": 0.25, "security": 0.15, "performance": 0.20,
    "dataDesign": 0.10, "durability": 0.20, "operations": 0.10,
}
# Dimension of an issue type that names none itself; the first match counts.
DIMENSION_PATTERNS = [
    ("availability", r"disk|repl_thread|repl_delay|mem_high"),
    ("security", r"wildcard|empty_password|old_auth|pwd_|tls_weak"),
    ("performance", r"slow|bp_hit|long_query|sql_|hll|long_running_session"),
    ("dataDesign", r"no_pk|non_utf8|heavy_frag|unused_index|redundant_index|lct_"),
    ("durability", r"flush_log|sync_binlog|gtid|ibtmp1|swap|master_readonly|slave_writable|expire_logs"),
    ("operations", r"param_inconsistent|backup|slow_log_off|os_version"),
]
# The documented mapping charges these two types elsewhere than the patterns above.
DOCUMENTED_DIMENSIONS = {
    "mysql_version_eol": "operations",
    "mysql_version_security": "operations",
    "slow_log_off": "operations",
}

# Compliance frameworks: (name, required checks, partial counts).
FRAMEWORKS = [
    ("MLPS 2.0 level 3", ["strong_password_policy", "audit_log"], False),
    ("PCI DSS", ["innodb_encryption", "tls_enabled", "audit_log"], True),
    ("GDPR", ["audit_log"], True),
]

# Issue types listed in the replication chapter.
REPLICATION_ISSUES = [
    "gtid_off", "slave_parallel_workers_zero", "sync_binlog_weak", "repl_delay_high",
    "repl_delay_low", "repl_thread_down", "replica_io_running_no",
    "replica_sql_running_no", "self_ref_slave_residue",
]

# Restore speed assumed for restore-time estimates, bytes per second.
RESTORE_BYTES_PER_SECOND = 200 * 1024 * 1024

# Default thresholds.
DEFAULT_THRESHOLDS = {
    "disk.critical_pct": 90,
    "disk.high_pct": 80,
    "memory.high_pct": 90,
    "innodb.hll_warn": 10000,
    "innodb.hll_p1": 50000,
    "innodb.bp_hit_low_pct": 95,
    "innodb.bp_hit_warn_pct": 99,
    "innodb.bp_too_small_ratio": 0.4,
    "innodb.bp_too_small_p1_ratio": 0.2,
    "innodb.bp_too_large_ratio": 0.8,
    "innodb.bp_too_small_min_mem_gb": 4,
    "innodb.ibtmp1_max_gb": 5,
    "innodb.redo_log_min_mb": 512,
    "innodb.redo_log_db_gb_busy": 50,
    "innodb.redo_log_db_gb_heavy": 200,
    "session.long_running_seconds_warn": 60,
    "session.long_running_seconds_p2": 600,
    "replication.delay_p1_seconds": 300,
    "replication.delay_p2_seconds": 60,
    "replication.parallel_workers_data_gb_p2": 100,
    "replication.parallel_workers_data_gb_p1": 500,
    "sql.slow_query_abs_high": 1000000,
    "sql.slow_query_abs_med": 100000,
    "sql.long_query_time_loose": 5,
    "frag.rate": 0.7,
    "frag.min_mb": 100,
    "binlog.expire_logs_max_days": 30,
    "max_connections.peak_memory_ratio_warn": 0.3,
    "max_connections.peak_memory_ratio_p1": 0.5,
    "data_memory.ratio_warn": 10,
    "data_memory.ratio_p1": 50,
    "auto_increment.rate_p2": 0.7,
    "auto_increment.rate_p1": 0.8,
    "auto_increment.rate_p0": 0.9,
}

# The strict preset.
STRICT_PRESET = {
    "thresholds": {
        "disk.critical_pct": 80,
        "disk.high_pct": 70,
        "memory.high_pct": 80,
        "innodb.hll_warn": 5000,
        "innodb.hll_p1": 30000,
        "innodb.bp_hit_low_pct": 98,
        "innodb.bp_hit_warn_pct": 99,
        "innodb.bp_too_small_ratio": 0.5,
        "innodb.bp_too_small_p1_ratio": 0.3,
        "innodb.bp_too_large_ratio": 0.75,
        "session.long_running_seconds_warn": 30,
        "session.long_running_seconds_p2": 300,
        "replication.delay_p1_seconds": 60,
        "replication.delay_p2_seconds": 10,
        "replication.parallel_workers_data_gb_p2": 50,
        "replication.parallel_workers_data_gb_p1": 200,
        "sql.slow_query_abs_high": 500000,
        "sql.slow_query_abs_med": 50000,
        "sql.long_query_time_loose": 2,
        "frag.rate": 0.5,
        "frag.min_mb": 50,
        "binlog.expire_logs_max_days": 14,
        "max_connections.peak_memory_ratio_warn": 0.2,
        "max_connections.peak_memory_ratio_p1": 0.4,
        "data_memory.ratio_warn": 5,
        "data_memory.ratio_p1": 20,
    },
    "priorities": {},
    "disabledRules": [],
}

# The lenient preset.
LENIENT_PRESET = {
    "thresholds": {
        "disk.critical_pct": 95,
        "disk.high_pct": 85,
        "memory.high_pct": 95,
        "innodb.hll_warn": 30000,
        "innodb.hll_p1": 200000,
        "innodb.bp_hit_low_pct": 90,
        "innodb.bp_hit_warn_pct": 95,
        "innodb.bp_too_small_ratio": 0.3,
        "innodb.bp_too_small_p1_ratio": 0.1,
        "session.long_running_seconds_warn": 300,
        "session.long_running_seconds_p2": 1800,
        "replication.delay_p1_seconds": 600,
        "replication.delay_p2_seconds": 120,
        "sql.slow_query_abs_high": 5000000,
        "sql.slow_query_abs_med": 500000,
        "sql.long_query_time_loose": 10,
        "frag.rate": 0.8,
        "frag.min_mb": 500,
        "binlog.expire_logs_max_days": 60,
    },
    "priorities": {"wildcard_medium": "P3"},
    "disabledRules": [
        "sql_mode_missing_strict",
        "charset_not_utf8mb4",
        "auth_plugin_native_on_80",
        "performance_schema_off",
    ],
}
