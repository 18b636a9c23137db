"""Hand-written dumps of a four-node cluster, in the collector's format."""

from __future__ import annotations

import os


def box(headers, rows):
    cells = [[str(c) for c in r] for r in [headers, *rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(headers))]
    ruler = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    text = ["| " + " | ".join(c.ljust(w) for c, w in zip(r, widths)) + " |" for r in cells]
    return "\n".join([ruler, text[0], ruler, *text[1:], ruler])


def banner(title):
    return f"|{'+' * 40}|\n|  [{title}] module {title} |\n|{'+' * 40}|"


def marker(number, name):
    return f"----->>>---->>>  [{number:02d}] {name}"


def variables(**overrides):
    values = {
        "binlog_format": "ROW",
        "innodb_buffer_pool_size_in_mb": "40960.00000000",
        "innodb_log_file_size_in_mb": "1024.00000000",
        "innodb_flush_method": "O_DIRECT",
        "expire_logs_days": "7",
        "wait_timeout": "28800",
        "read_only": "1",
        "sort_buffer_size_in_kb": "256.0000",
        "join_buffer_size_in_kb": "256.0000",
        "read_buffer_size_in_kb": "128.0000",
        "read_rnd_buffer_size_in_kb": "256.0000",
        "tmp_table_size_in_mb": "16.00000000",
        "slave_parallel_workers": "0",
        "gtid_mode": "ON",
        "innodb_doublewrite": "ON",
        "innodb_flush_log_at_trx_commit": "1",
        "sync_binlog": "1",
        "innodb_temp_data_file_path": "ibtmp1:12M:autoextend",
        "open_files_limit": "65535",
        "slow_query_log": "1",
        "long_query_time": "1.000000",
        "lower_case_table_names": "1",
        "max_connections": "1000",
        "transaction_isolation": "READ-COMMITTED",
    }
    values.update({k: v for k, v in overrides.items() if v is not None})
    lines = ["*************************** 1. row ***************************"]
    for name, value in values.items():
        prefix = "@@global." if name in ("wait_timeout", "read_only", "gtid_mode") else ""
        lines.append(f"{prefix + name:>40}: {value}")
    return "\n".join(lines)


def replica_status(master, lag=0, io="Yes", sql="Yes"):
    return "\n".join(
        [
            "*************************** 1. row ***************************",
            "               Slave_IO_State: Waiting for master to send event",
            f"                  Master_Host: {master}",
            "                  Master_User: repl",
            "                  Master_Port: 3306",
            "              Master_Log_File: mysql-bin.000123",
            "          Read_Master_Log_Pos: 154",
            "        Relay_Master_Log_File: mysql-bin.000123",
            f"             Slave_IO_Running: {io}",
            f"            Slave_SQL_Running: {sql}",
            "                Last_IO_Error: ",
            "               Last_SQL_Error: ",
            f"        Seconds_Behind_Master: {lag}",
            "             Master_Server_Id: 2",
            "                  Master_UUID: 5f0f-11",
            "      Slave_SQL_Running_State: Slave has read all relay log",
            "           Retrieved_Gtid_Set: 5f0f-11:1-10",
            "            Executed_Gtid_Set: 5f0f-11:1-10",
            "                Auto_Position: 1",
        ]
    )


REPLICA_HOSTS = box(
    ["Server_id", "Host", "Port", "Master_id", "Slave_UUID"],
    [["3", "", "3306", "2", "a-3"], ["4", "", "3306", "2", "a-4"], ["101", "", "3306", "2", "a-101"]],
)

ENGINE_STATUS = """
------------------------
LATEST DETECTED DEADLOCK
------------------------
2026-04-30 01:02:03 two transactions wait for each other
*** WE ROLL BACK TRANSACTION (1)
------------
TRANSACTIONS
------------
History list length {hll}
---TRANSACTION 421, not started
0 lock struct(s)
---TRANSACTION 900, ACTIVE 12 sec fetching rows
mysql tables in use 1, locked 1
--END
Log sequence number 8889
Log flushed up to   8880
Pages read 10, created 20, written 30
Buffer pool size   8192
Free buffers       100
Database pages     8000
Modified db pages  5
Buffer pool hit rate 985 / 1000
"""

TEMP_TABLESPACE = box(
    ["FILE_ID", "FILE_NAME", "TABLESPACE_NAME", "TOTAL_EXTENTS", "EXTENT_SIZE", "INITIAL_SIZE",
     "AUTOEXTEND_SIZE", "DATA_FREE"],
    [["1", "./ibtmp1", "innodb_temporary", "7168", "1048576", "12582912", "67108864", "6291456"]],
)

BACKUP_DIRS = f"""===== /data/backup =====
总大小: 93G
最近修改文件 (TOP 20)：
2024-07-29+03:10:11.5 51539607552 /data/backup/tbl_order_detail_20240729.sql
2024-07-24+03:10:11.5 13958643712 /data/backup/tbl_order_20240724.sql
[--] /opt/backup 不存在
[--] /data/mysql/backup 不存在
"""

PROCESSES = box(
    ["ID", "USER", "HOST", "DB", "COMMAND", "TIME", "STATE", "INFO"],
    [
        ["1", "event_scheduler", "localhost", "NULL", "Daemon", "9999999", "Waiting on empty queue", "NULL"],
        ["2", "repl", "172.16.7.3:4567", "NULL", "Binlog Dump", "88888", "Master has sent all", "NULL"],
        ["3", "app", "10.1.1.1:555", "shop", "Query", "700", "Sending data", "select 1"],
        ["4", "app", "10.1.1.1:556", "shop", "Sleep", "9000", "", "NULL"],
    ],
)


def dump(
    ip="172.16.7.2",
    hostname="db-a",
    release="CentOS release 6.9 (Final)",
    mem=("65536000", "1000000", "200000", "2000000"),
    swap=("4194304", "4194304"),
    disk=("91%", "45%"),
    repl=REPLICA_HOSTS,
    hll=20000,
    uptime="152 days 8 hours 44 min 21 sec",
    version="5.7.30-log",
    slow=1200000,
    qps="1500.5",
    backup=None,
    processes=PROCESSES,
    with_security=True,
    **overrides,
):
    mem_total, mem_free, buffers, cached = mem
    parts = [
        banner("01"),
        (1, "hostname", hostname),
        (1, "os kernal", "Linux db 2.6.32-696.el6.x86_64"),
        (1, "os release", "cat: /etc/os-release: No such file or directory\n" + release),
        (1, "mem info", f"MemTotal:       {mem_total} kB\nMemFree:        {mem_free} kB\nBuffers:  {buffers} kB\n"
                        f"Cached:   {cached} kB\nSwapCached:  77 kB\nSwapTotal:  {swap[0]} kB\nSwapFree:   {swap[1]} kB"),
        (1, "CPU cores", "32"),
        (1, "CPU model", "Intel(R) Xeon(R)"),
        (1, "disk mount", "Filesystem            Size  Used Avail Use% Mounted on\n"
                          "/dev/mapper/vg_root-lv_root\n"
                          f"                       50G   40G   10G  {disk[0]} /\n"
                          f"/dev/sdb1             1.0T  450G  550G  {disk[1]} /data"),
        (1, "resource limit", "open files                      (-n) 1024"),
        (1, "my.cnf detail", f"[mysqld]\nserver_id = 1\nserver_id = {ip.rsplit('.', 1)[1]}\nlog_bin = mysql-bin"),
        banner("02"),
        (2, "MySQL Database Version",
         f"Server version:\t\t{version}\nUptime:\t\t\t{uptime}\n\nThreads: 120  Questions: 987654321  "
         f"Slow queries: {slow}  Opens: 100  Flush tables: 1  Open tables: 99  Queries per second avg: {qps}"),
        (3, "MySQL Variables", variables(**overrides)),
        banner("04"),
        (4, "MySQL Replication Info", repl),
        (5, "DB TOTAL SIZE", box(["database_name", "DATABASE SIZE GB"],
                                 [["DATABASE TOTAL SIZE", "620.500"], ["shop", "600.000"], ["pay", "20.500"]])),
        (5, "Database objects summary", box(["db_name", "ob_type", "sums"], [["shop", "TABLE", "12"], ["shop", "VIEW", "2"]])),
        (5, "Top 10 Tables", box(["table_schema", "table_name", "SIZE(GB)", "table_rows", "engine"],
                                 [["shop", "orders", "300.5", "1000000", "InnoDB"],
                                  ["shop", "orders_20240101", "100.0", "5000", "InnoDB"]])),
        (5, "Tables fragment rate > 30%",
         box(["TABLE_SCHEMA", "TABLE_NAME", "table_rows", "data_length", "index_length", "data_free", "fragment_rate"],
             [["shop", "_orders_gho", "10", "2000000000", "0", "8000000000", "0.80"],
              ["shop", "carts", "10", "2000000000", "0", "1000000000", "0.33"]])),
        (5, "Not utf8 table", box(["TABLE_SCHEMA", "TABLE_NAME", "TABLE_COLLATION"], [["shop", "old", "latin1_swedish_ci"]])),
        (5, "database CHARACTER", box(["SCHEMA_NAME", "DEFAULT_CHARACTER_SET_NAME", "DEFAULT_COLLATION_NAME"],
                                      [["shop", "utf8mb4", "utf8mb4_general_ci"], ["pay", "utf8", "utf8_general_ci"]])),
        (5, "auto_increment usage", box(["table_schema", "table_name", "column_name", "AUTO_INCREMENT", "auto_increment_rate"],
                                        [["shop", "orders", "id", "1900000000", "0.8847"], ["shop", "carts", "id", "100", "0.0001"]])),
        (5, "NO PRIMARY KEY TABLES", box(["table_schema", "table_name"], [["shop", "ledger_entries"], ["shop", "orders_bak"]])),
        (5, "innodb_tablespaces (含 ibtmp1)", TEMP_TABLESPACE),
        banner("06"),
        (6, "user check", box(["user", "host", "password_expired", "password_last_changed", "password_lifetime", "account_locked", "plugin"],
                              [["root", "%", "N", "2024-01-01", "NULL", "N", "mysql_native_password"],
                               ["app", "%", "N", "2024-01-01", "NULL", "N", "x"],
                               ["zabbix", "%", "N", "2024-01-01", "NULL", "N", "x"],
                               ["app", "10.%", "N", "2024-01-01", "NULL", "N", "x"]])),
        (6, "failed login attempts (host_cache)", ""),
        (7, "Processlist info", processes),
        (7, "INNODB LOCKS", ""),
        (7, "INNODB LOCK WAITS", ""),
        (7, "INNODB TRX", ""),
        (7, "LOCK DETAILS (waiting & blocking)", ""),
        (7, "Metadata locks", ""),
        (7, "Lock status counters", box(["VARIABLE_NAME", "VARIABLE_VALUE"],
                                        [["Innodb_row_lock_current_waits", "0"], ["Table_locks_waited", "7"]])),
        (8, "Engine innodb status", ENGINE_STATUS.format(hll=hll)),
        (9, "TOP 20 SQL by total latency",
         box(["query", "db", "exec_count", "total_latency", "avg_latency", "max_latency", "rows_examined", "rows_sent",
              "examined_per_sent", "FIRST_SEEN", "LAST_SEEN", "DIGEST"],
             [["SELECT * FROM orders", "shop", "10", "3 s", "1 s", "2 s", "100", "10", "10.0", "x", "y", "d1"],
              ["SHOW TABLES", "shop", "10", "3 s", "1 s", "2 s", "100", "10", "10.0", "x", "y", "d2"],
              ["SELECT a | b FROM t", "shop", "10", "3 s", "1 s", "2 s", "100", "10", "10.0", "x", "y", "d3"]])),
        (9, "Schema unused indexes", box(["object_schema", "object_name", "index_name"],
                                         [["shop", "orders", "ix_a"], ["shop", "orders_bak", "ix_b"], ["shop", "tmp_x", "ix_c"]])),
        (9, "Schema redundant indexes",
         box(["table_schema", "table_name", "redundant_index_name", "redundant_index_columns", "redundant_index_non_unique",
              "dominant_index_name", "dominant_index_columns", "dominant_index_non_unique", "subpart_exists", "sql_drop_index"],
             [["shop", "orders", "ix_a", "a", "1", "ix_ab", "a,b", "1", "0", "ALTER TABLE ..."]])),
        (10, "Slow query log status", "slow_query_log: 1\nfile size: 2.5G"),
        (10, "Slow query log tail (last 5000 lines)",
         "# Time: 2026-04-30T01:00:00\n# User@Host: app[app] @  [10.1.1.1]\n# Query_time: 12.5  Lock_time: 0.1 Rows_sent: 1  Rows_examined: 500\n"
         "use shop;\nSET timestamp=1;\nSELECT *\n  FROM orders;\n"
         "# Time: 2026-04-30T00:00:00\n# User@Host: app[app] @  [10.1.1.1]\n# Query_time: 2.5  Lock_time: 0.1 Rows_sent: 1  Rows_examined: 900\n"
         "SELECT 2;"),
        (10, "Error log status", "log_error: /x\nfile size: 150M"),
        (10, "Error log tail (last 1000 lines)",
         "2026 [Note] ERROR inside a note\n2026 [ERROR] bad page\n2026 [Warning] aborted connection\n2026 [Note] ready for connections\n"),
        banner("11"),
        (11, "Backup tools available", "[OK] mysqldump: /usr/bin/mysqldump\nmysqldump  Ver 10\n[--] xtrabackup: NOT FOUND"),
        (11, "Crontab for mysql user", "(mysql 用户无 crontab 或权限不足)"),
        (11, "Crontab for root", "0 3 * * * /bin/bash /opt/db_bak/bak_dir/db_backup.sh > /tmp/x.log"),
        (11, "System cron files for backup", ""),
        (11, "Backup directory inspection", backup if backup is not None else "[--] /data/backup 不存在"),
        (11, "Binlog directory", "binlog dir: /data/mysql/binlog\n总大小: 52G\ntotal 1"),
        banner("12"),
    ]
    if with_security:
        parts += [
            (12, "Audit plugin status", "(无审计相关插件)"),
            (12, "TLS / SSL configuration", box(["Variable_name", "Value"],
                                                [["have_ssl", "YES"], ["tls_version", "TLSv1,TLSv1.1,TLSv1.2"], ["require_secure_transport", "OFF"]])),
            (12, "Password validation policy", ""),
            (12, "InnoDB encryption status", ""),
            (12, "Keyring plugin", "(无 keyring 插件)"),
            (12, "Users with empty password", ""),
            (12, "Users with old auth plugin", box(["user", "host", "plugin"], [["root", "%", "mysql_native_password"]])),
            (12, "Global SQL_MODE", box(["@@global.sql_mode"], [["NO_ENGINE_SUBSTITUTION"]])),
        ]
    out = []
    for part in parts:
        if isinstance(part, tuple):
            number, name, body = part
            out.append(marker(number, name))
            if body:
                out.append(body)
        else:
            out.append(part)
    return "\n".join(out) + "\n"


def cluster():
    """File name -> dump text."""
    replica = dict(processes="", release="CentOS Linux release 7.9.2009 (Core)", hll=10)
    return {
        "MyHealthCheck_172.16.7.2_202604301023.txt": dump(read_only="0"),
        "MyHealthCheck_172.16.7.3_202604301023.txt": dump(
            ip="172.16.7.3", hostname="db-b", repl=replica_status("172.16.7.2", lag=400), disk=("85%", "45%"),
            uptime="3 hours 2 min", qps="300.0", **replica),
        "MyHealthCheck_172.16.7.4_202604301023.txt": dump(
            ip="172.16.7.4", hostname="db-c", repl=replica_status("172.16.7.2", lag=70), backup=BACKUP_DIRS,
            disk=("10%", "45%"), swap=("4194304", "900000"), **replica),
        "MyHealthCheck_172.16.128.101_202604301023.txt": dump(
            ip="172.16.128.101", hostname="dr-db", repl=replica_status("172.16.7.2", lag=0), read_only="0",
            long_query_time="10.000000", disk=("10%", "45%"), **replica),
    }


def write_cluster(folder):
    os.makedirs(folder, exist_ok=True)
    for name, text in cluster().items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
    return folder
