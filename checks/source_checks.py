"""SRC-*: views written as dump text, parsed back, and compared with the views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import dumps as D
from checks.catalog_checks import K, RATE, plain
from checks.registry import check
from checks.views import VARIABLES
from fleetvitals import KEYS
from fleetvitals.functions import fixed_values as fv
from fleetvitals.operators import workload
from fleetvitals.plans.lineage import shared_folder
from fleetvitals.sources import ingest, parse, tables

GIB = 1073741824


def parsed(dumps: DataFrame, *names: str) -> DataFrame:
    return ingest.with_sections(dumps, list(names))


def facts(dumps: DataFrame, *names: str) -> DataFrame:
    return parse.node_facts(parsed(dumps, *names))


def chunk_ip(key: str, size: int = D.CHUNK) -> str:
    c = f"(({key}) // {size})"
    return f"concat('172.', {c} // 65536 % 256, '.', {c} // 256 % 256, '.', {c} % 256)"


def chunk_keys(key: str, size: int = D.CHUNK) -> str:
    return f"({key}) // {size} % 25 AS cluster_id, {chunk_ip(key, size)} AS node_ip"


@check("src_01_select_dumps", "SELECT cluster_id, node_ip, file_name FROM {nodes} WHERE k % 5 <> 0")
def _(v):
    name = F.when(F.col("k") % 5 == 0, F.concat(F.lit("notes_"), "file_name")).otherwise(F.col("file_name"))
    files = v["nodes"].withColumn("file_name", F.regexp_replace(name, "^notes_Health", "notes-Health"))
    return plain(files.filter(F.col("file_name").rlike(fv.DUMP_FILE_PATTERN)).select(*KEYS, "file_name"))


@check("src_02_file_name_facts", "SELECT concat('c', cluster_id) AS cluster_id, node_ip, snapshot_date, 'unnamed' AS project FROM {nodes}")
def _(v):
    files = v["nodes"].select("file_name", F.concat(F.lit("/x/c"), F.col("cluster_id").cast("string"), F.lit("/"), "file_name").alias("file_path"))
    return ingest.file_name_facts(files, "2020-01-01").select("cluster_id", "node_ip", "snapshot_date", "project")


def small(v) -> DataFrame:
    return D.node_dumps(
        v,
        D.section(1, "hostname", "", F.col("hostname")),
        D.section(1, "CPU cores", "", F.col("cpu_cores")),
        F.lit(D.banner(3)),
        D.section(5, "Top 10 Tables (all)", F.concat(F.lit("| a | b |\n| "), F.col("k").cast("string"), F.lit(" | x |"))),
        D.section(9, "Empty one"),
    )


SMALL = f"""
SELECT {K}, 'hostname' AS section, 0 AS line_no, hostname AS line FROM {{nodes}}
UNION ALL SELECT {K}, 'CPU cores', 0, CAST(cpu_cores AS VARCHAR) FROM {{nodes}}
UNION ALL SELECT {K}, 'Top 10 Tables (all)', 0, '| a | b |' FROM {{nodes}}
UNION ALL SELECT {K}, 'Top 10 Tables (all)', 1, concat('| ', k, ' | x |') FROM {{nodes}}"""


@check("src_03_section_lines", SMALL)
def _(v):
    lines = ingest.strip_banners(ingest.section_lines(small(v)))
    return plain(lines.filter(F.col("line") != "").drop("block_no"))


@check("src_04_section_presence", f"""
SELECT {K}, 'hostname' AS section, 1 AS n_rows, 'collected' AS status FROM {{nodes}} UNION ALL SELECT {K}, 'Top 10 Tables', 2, 'collected' FROM {{nodes}}
UNION ALL SELECT {K}, 'Empty one', 0, 'collected_empty' FROM {{nodes}} UNION ALL SELECT {K}, 'Keyring plugin', 0, 'not_collected' FROM {{nodes}}""")
def _(v):
    names = ["hostname", "Top 10 Tables", "Empty one", "Keyring plugin"]
    found = ingest.section_presence(parsed(small(v), *names), names)
    return plain(found.withColumn("n_rows", F.col("n_rows").cast("int")))


def top_dumps(v) -> DataFrame:
    """Object tables as boxed text; every seventh name holds a pipe and breaks its row."""
    name = F.when(F.col("k") % 7 == 0, F.concat("table_name", F.lit("|x"))).otherwise(F.col("table_name"))
    entry = D.row("table_schema", name, F.col("data_length") / GIB, "table_rows", "engine")
    chunks = D.chunked(v["cat_tables"], "k", entry)
    return D.chunk_dumps(chunks, 5, "Top 10 Tables", D.box(["table_schema", "table_name", "SIZE(GB)", "table_rows", "engine"], F.col("entries")))


TOP = "Top 10 Tables"


@check("src_05_boxed_rows", f"""
SELECT {chunk_keys('k')}, '{TOP}' AS section, k % 7 <> 0 AS is_valid, CASE WHEN k % 7 = 0 THEN 6 ELSE 5 END AS width, count(*) AS n FROM {{cat_tables}} GROUP BY ALL""")
def _(v):
    rows = ingest.boxed_rows(parsed(top_dumps(v), TOP))
    return rows.groupBy("cluster_id", "node_ip", "section", "is_valid", F.size("cells").alias("width")).agg(F.count(F.lit(1)).alias("n"))


@check("src_05_quarantine", f"SELECT {chunk_keys('k')}, concat(table_name, '|x') AS name FROM {{cat_tables}} WHERE k % 7 = 0")
def _(v):
    rows = ingest.quarantine(ingest.boxed_rows(parsed(top_dumps(v), TOP)))
    return plain(rows.select(*KEYS, F.concat_ws("|", F.get("cells", F.lit(1)), F.get("cells", F.lit(2))).alias("name")))


@check("src_06_strip_banners", "SELECT cluster_id, node_ip, 'Top 10 Tables (all)' AS section, 2 AS n FROM {nodes}")
def _(v):
    lines = ingest.strip_banners(ingest.section_lines(small(v)))
    kept = lines.filter(F.trim("line").startswith("|"))
    return kept.groupBy("cluster_id", "node_ip", "section").agg(F.count(F.lit(1)).cast("int").alias("n"))


def variable_dumps(v) -> DataFrame:
    cnf = D.section(1, "my.cnf detail", "[mysqld]\nserver_id = 1\n server_id=", F.col("k"), "\nlog_bin = other-bin")
    return D.node_dumps(v, cnf, D.section(3, "MySQL Variables", "", D.variable_lines([n for n in VARIABLES if n != "server_id"])))


VAR_SECTIONS = ("MySQL Variables", "my.cnf detail")


@check("src_07_variables", f"SELECT {K}, name, value FROM {{variables}} WHERE name NOT IN ('server_id', 'log_bin')")
def _(v):
    found = parse.variables(facts(variable_dumps(v), *VAR_SECTIONS))
    return plain(found.filter(~F.col("name").isin("server_id", "log_bin")))


@check("src_08_cnf_overrides", f"SELECT {K}, CAST(k AS VARCHAR) AS server_id, v_log_bin AS log_bin FROM {{nodes}}")
def _(v):
    found = facts(variable_dumps(v), *VAR_SECTIONS)
    return plain(found.select(*KEYS, F.col("variables")["server_id"].alias("server_id"), F.col("variables")["log_bin"].alias("log_bin")))


def host_dumps(v) -> DataFrame:
    total = F.col("mem_total_kb")
    used = F.floor(total * F.col("mem_pct") / 100)
    return D.node_dumps(
        v,
        D.section(1, "hostname", "", F.col("hostname")),
        D.section(1, "os kernal", "", F.col("os_kernel")),
        D.section(1, "os release", "cat: /etc/x: No such file\n", F.when(F.col("k") % 6 == 3, F.concat(F.lit('PRETTY_NAME="'), "os_release", F.lit('"'))).otherwise(F.col("os_release"))),
        D.section(1, "mem info", "MemTotal:       ", total, " kB\nMemFree:   ", total - used - 300, " kB\nBuffers:   100 kB\nCached:   200 kB\nSwapCached:   5 kB\nSwapTotal:   ",
                  F.col("swap_total_kb"), " kB\nSwapFree:   ", F.col("swap_total_kb") - F.col("swap_used_kb"), " kB"),
        D.section(1, "CPU cores", "", F.col("cpu_cores")),
        D.section(1, "CPU model", "", F.col("cpu_model")),
        D.section(1, "disk mount", "Filesystem  Size Used Avail Use% Mounted on\n/dev/mapper/very_long_name\n      50G 40G 10G ", F.col("root_pct"),
                  "% /\n/dev/sdb1 1T 1T 1T ", F.col("data_pct"), "% /data"),
        D.section(1, "resource limit", "open files                      (-n) 1024"),
        D.section(1, "mysqld process limits", F.when(F.col("k") % 2 == 0, F.concat(F.lit("Max open files            "), (F.col("k") + 4096).cast("string"), F.lit("  files"))).otherwise("")),
    )


HOST_SECTIONS = ("hostname", "os kernal", "os kernel", "os release", "mem info", "CPU cores", "CPU model", "disk mount", "resource limit", "mysqld process limits")


@check("src_09_memory", f"""
SELECT {K}, mem_total_kb, CAST(floor(mem_total_kb * mem_pct / 100) AS BIGINT) AS mem_used_kb, mem_pct, swap_total_kb, swap_used_kb, swap_pct FROM {{nodes}}""")
def _(v):
    return plain(facts(host_dumps(v), *HOST_SECTIONS).select(*KEYS, "mem_total_kb", "mem_used_kb", "mem_pct", "swap_total_kb", "swap_used_kb", "swap_pct"))


@check("src_10_disks", f"SELECT {K}, CASE mount WHEN '/' THEN '/dev/mapper/very_long_name' ELSE '/dev/sdb1' END AS filesystem, mount, use_pct FROM {{disks}}")
def _(v):
    return plain(parse.disks(facts(host_dumps(v), *HOST_SECTIONS)).select(*KEYS, "filesystem", "mount", "use_pct"))


@check("src_11_host_facts", f"SELECT {K}, hostname, os_kernel, os_release, cpu_cores, cpu_model FROM {{nodes}}")
def _(v):
    return plain(facts(host_dumps(v), *HOST_SECTIONS).select(*KEYS, "hostname", "os_kernel", "os_release", "cpu_cores", "cpu_model"))


@check("src_12_open_files_limit", f"SELECT {K}, CASE WHEN k % 2 = 0 THEN k + 4096 ELSE 1024 END AS open_files_limit FROM {{nodes}}")
def _(v):
    return plain(facts(host_dumps(v), *HOST_SECTIONS).select(*KEYS, "open_files_limit"))


@check("src_13_server_status", f"SELECT {K}, server_version, uptime_sec, threads_connected, questions, slow_queries, qps FROM {{nodes}}")
def _(v):
    version = D.section(
        2, "MySQL Database Version", "Server version:\t\t", F.col("server_version"), "\nUptime:\t\t\t", (F.coalesce("uptime_sec", F.lit(0)) / 86400).cast("int"), " days 0 hours 0 min 0 sec\n\nThreads: ",
        F.col("threads_connected"), "  Questions: ", F.col("questions"), "  Slow queries: ", F.col("slow_queries"), "  Opens: 5  Flush tables: 1  Queries per second avg: ", F.col("qps"))
    found = facts(D.node_dumps(v, version), "MySQL Database Version")
    return plain(found.select(*KEYS, "server_version", "uptime_sec", "threads_connected", "questions", "slow_queries", "qps"))


@check("src_14_replication", f"""
SELECT {K}, is_replica, CASE WHEN is_replica THEN master_host END AS master_host, CASE WHEN is_replica THEN io_running END AS io_running, CASE WHEN is_replica THEN sql_running END AS sql_running,
  CASE WHEN is_replica THEN lag_seconds END AS lag_seconds, CASE WHEN is_replica THEN concat('uuid-', k) END AS master_uuid, CASE WHEN NOT is_replica THEN 2 END AS connected_replicas FROM {{nodes}}""")
def _(v):
    status = D.lines(
        "  Slave_IO_State: Waiting\n  Master_Host: ", F.col("master_host"), "\n  Slave_IO_Running: ", F.col("io_running"), "\n  Slave_SQL_Running: ", F.col("sql_running"),
        "\n  Last_IO_Error: \n  Seconds_Behind_Master: ", F.col("lag_seconds"), "\n  Master_Server_Id: 7\n  Master_UUID: uuid-", F.col("k"))
    hosts = "| Server_id | Host | Slave_UUID |\n| 3 | a | u3 |\n| 4 | b | u4 |"
    body = F.when(F.col("is_replica"), status).otherwise(hosts)
    found = facts(D.node_dumps(v, D.section(4, "MySQL Replication Info", "", body)), "MySQL Replication Info")
    return plain(found.select(*KEYS, "is_replica", "master_host", "io_running", "sql_running", "lag_seconds", "master_uuid", F.col("connected_replicas").cast("int").alias("connected_replicas")))


def engine_dumps(v) -> DataFrame:
    body = D.lines(
        "------------------------\nLATEST DETECTED DEADLOCK\n------------------------\ndeadlock ", F.col("k"), "\n------------\nTRANSACTIONS\n------------\nHistory list length ", F.col("history_list"),
        "\n---TRANSACTION ", F.col("k"), ", ACTIVE 5 sec\nlocked ", F.col("k"), "\n---TRANSACTION 9, not started\nx\n--END\nLog sequence number ", F.col("questions"), "\nLog flushed up to   5\nPages read 1, created 2, written ", F.col("k"),
        "\nBuffer pool size   8192\nFree buffers       10\nDatabase pages     8000\nModified db pages  3\nBuffer pool hit rate ", F.col("bp_hits"), " / 1000")
    return D.node_dumps(v, D.section(8, "Engine innodb status", "", body))


@check("src_15_engine_status", f"""SELECT {K}, history_list, bp_hits, bp_lookups, 8192 AS bp_pages, k AS pages_written, concat('deadlock ', k) AS latest_deadlock FROM {{nodes}}""")
def _(v):
    found = facts(engine_dumps(v), "Engine innodb status")
    return plain(found.select(*KEYS, "history_list", "bp_hits", "bp_lookups", F.col("bp_pages").cast("int").alias("bp_pages"), "pages_written", "latest_deadlock"))


@check("src_15_active_trx", f"SELECT {K}, CAST(k AS VARCHAR) AS trx_id, 'ACTIVE 5 sec' AS state, concat('locked ', k) AS detail FROM {{nodes}}")
def _(v):
    return plain(parse.active_trx(parsed(engine_dumps(v), "Engine innodb status")))


def temp_dumps(v) -> DataFrame:
    extents = F.floor(F.col("temp_bytes") / 1048576)
    new = F.concat(F.lit("| SPACE | NAME | FILE_SIZE | AUTOEXTEND_SIZE |\n| 1 | ./ibtmp1 | "), F.col("temp_bytes").cast("string"), F.lit(" | 67108864 |"))
    old = F.concat(F.lit("| NAME | TOTAL_EXTENTS | EXTENT_SIZE | INITIAL_SIZE | DATA_FREE |\n| innodb_temporary | "), extents.cast("string"), F.lit(" | 1048576 | 12582912 | 5 |"))
    none = F.lit("| NAME | FILE_SIZE |\n| other | 5 |")
    body = F.when(F.col("temp_bytes").isNull(), none).when(F.col("k") % 2 == 0, new).otherwise(old)
    config = D.section(3, "MySQL Variables", "innodb_temp_data_file_path: ", F.col("v_innodb_temp_data_file_path"))
    return D.node_dumps(v, config, D.section(5, "innodb_tablespaces (temp)", "", body))


@check("src_16_temp_tablespace", f"""
SELECT {K}, temp_bytes AS size_bytes, CASE WHEN temp_bytes IS NULL THEN NULL WHEN k % 2 = 0 THEN '12M' ELSE '12.00 MB' END AS initial_size,
  CASE WHEN temp_bytes IS NULL THEN NULL WHEN k % 2 = 0 THEN '64.00 MB' ELSE 'autoextend' END AS auto_extend, TRUE AS temp_collected FROM {{nodes}}""")
def _(v):
    found = facts(temp_dumps(v), "MySQL Variables", "innodb_tablespaces")
    return plain(found.select(*KEYS, "temp.size_bytes", "temp.initial_size", "temp.auto_extend", "temp_collected"))


@check("src_17_temp_tablespace_html", f"""
SELECT {K}, CASE WHEN k = 0 THEN 7 WHEN k % 3 = 0 THEN k * 4096 * 1048576 ELSE NULL END AS size_bytes, CASE WHEN k % 3 = 0 THEN 'html' ELSE NULL END AS source FROM {{nodes}}""")
def _(v):
    cells = ["9"] * 38
    before = "".join(f"<td>{c}</td>" for c in ["1", "./ibtmp1", *cells[2:14]])
    after = "".join(f"<td>{c}</td>" for c in ["1048576", "12582912", "0", "67108864", *cells[19:31], "7", *cells[32:]])
    other = "<tr><td>a</td></tr>"
    row = D.lines(f"<table>{other}<tr>{before}<td>", F.col("k") * 4096, f"</td>{after}</tr></table>")
    reports = v["nodes"].select(*KEYS, F.when(F.col("k") % 3 == 0, row).otherwise(other).alias("content"))
    nodes = v["nodes"].select(*KEYS, F.lit(None).cast("struct<size_bytes:bigint,free_bytes:bigint,initial_size:string,auto_extend:string,source:string>").alias("temp"))
    merged = parse.apply_html_temp(nodes, parse.temp_tablespace_html(reports))
    return plain(merged.select(*KEYS, "temp.size_bytes", "temp.source"))


def slow_log_texts(v) -> DataFrame:
    # Every fourth time mark has a second statement, of another user and without a database, under it.
    second = D.lines("\n# User@Host: second[s] @ [10.0.0.2]\n# Query_time: 9.5  Lock_time: 0.5 Rows_sent: 2  Rows_examined: ", F.col("o_orderkey"), "\nUPDATE t", F.col("o_custkey"), ";")
    entry = D.lines(
        "# Time: ", F.date_format("o_orderdate", "yyyy-MM-dd"), "\n# User@Host: u", F.col("o_custkey"), "[u] @ [10.0.0.1]\n# Query_time: ", (F.col("o_totalprice") * 100).cast("bigint"),
        ".5  Lock_time: 0.25 Rows_sent: 1  Rows_examined: ", F.col("o_orderkey"), "\nuse db", F.col("o_custkey") % 3, ";\nSET timestamp=1;\nSELECT ", F.col("o_orderkey"), "\n  FROM t;", F.when(F.col("o_orderkey") % 4 == 0, second).otherwise(""))
    return D.chunked(v["orders"], "o_orderkey", entry).select(*KEYS, F.concat(F.lit("server started with:\n"), F.array_join("entries", "\n")).alias("text"))


SLOW = f"""SELECT {chunk_keys('o_orderkey')}, strftime(o_orderdate, '%Y-%m-%d') AS time, concat('u', o_custkey, '[u] @ [10.0.0.1]') AS user_host, CAST(floor(o_totalprice * 100) AS BIGINT) + 0.5::DOUBLE AS query_s,
  0.25::DOUBLE AS lock_s, CAST(1 AS BIGINT) AS rows_sent, o_orderkey AS rows_examined, concat('db', o_custkey % 3) AS db, concat('SELECT ', o_orderkey, ' FROM t;') AS sql FROM orders
UNION ALL SELECT {chunk_keys('o_orderkey')}, strftime(o_orderdate, '%Y-%m-%d'), 'second[s] @ [10.0.0.2]', 9.5::DOUBLE, 0.5::DOUBLE, CAST(2 AS BIGINT), o_orderkey, NULL, concat('UPDATE t', o_custkey, ';') FROM orders WHERE o_orderkey % 4 = 0"""


def slow_entries(v) -> DataFrame:
    return parse.slow_log_entries(slow_log_texts(v))


@check("src_18_slow_log_entries", SLOW)
def _(v):
    return plain(slow_entries(v))


def error_texts(v) -> DataFrame:
    kind = F.col("event_type")
    line = D.lines("2024 ", F.when(kind == "error", "[ERROR] bad").when(kind == "signup", "[Warning] odd").when(kind == "view", "[Note] ready for connections").otherwise("[Note] ERROR as text"), " ", F.col("event_id"))
    return D.chunked(v["events"], "event_id", line).select(*KEYS, F.array_join("entries", "\n").alias("text"))


ERRORS = f"""SELECT {chunk_keys('event_id')}, event_id % {D.CHUNK} AS line_no, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' WHEN 'view' THEN 'lifecycle' END AS severity FROM events"""


LOGGED = "concat('2024 ', CASE event_type WHEN 'error' THEN '[ERROR] bad' WHEN 'signup' THEN '[Warning] odd' WHEN 'view' THEN '[Note] ready for connections' ELSE '[Note] ERROR as text' END, ' ', event_id)"


@check("src_19_full_error_logs", f"""
SELECT concat('cluster=c', user_id % 25) AS cluster_id, concat('10.0.0.', user_id % 25) AS node_ip, CAST(row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id) - 1 AS INTEGER) AS line_no,
  {LOGGED} AS line, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' WHEN 'view' THEN 'lifecycle' END AS severity FROM events""")
def _(v):
    """A log file per cluster, written in order and read back in splits."""
    path = f"{shared_folder(v.spark)}/error-logs-{uuid.uuid4().hex}"
    cluster = (F.col("user_id") % 25).cast("string")
    lines = v["events"].select(F.concat(F.lit("c"), cluster).alias("cluster"), F.concat(F.lit("10.0.0."), cluster).alias("ip"), "event_id", F.expr(LOGGED).alias("value"))
    lines.repartition("cluster").sortWithinPartitions("cluster", "ip", "event_id").drop("event_id").write.partitionBy("cluster", "ip").text(path)
    return parse.read_error_logs(v.spark, path, "2024-01-31").select("cluster_id", "node_ip", "line_no", "line", "severity")


@check("src_19_error_log_lines", ERRORS)
def _(v):
    return plain(parse.error_log_lines(error_texts(v)).drop("line")).withColumn("line_no", F.col("line_no").cast("bigint"))


def summary_sql(columns: str, source: str) -> str:
    return f"SELECT cluster_id, node_ip, {columns} FROM ({source}) GROUP BY cluster_id, node_ip"


@check("sql_08_slow_log_summary", summary_sql("count(*) AS n_entries, max(query_s) AS max_query_s, sum(query_s) / count(*) AS avg_query_s, max(rows_examined) AS max_rows_examined, min(time) AS first_time, max(time) AS last_time", SLOW))
def _(v):
    return plain(workload.slow_log_summary(slow_entries(v)))


@check("sql_08_slow_log_top", f"SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id, node_ip ORDER BY query_s DESC, time, sql) AS INT) AS rnk FROM ({SLOW}) QUALIFY rnk <= 20")
def _(v):
    return plain(workload.slow_log_top(slow_entries(v)))


@check("sql_09_error_log_summary", summary_sql("count(*) AS n_lines, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings, count(*) FILTER (severity = 'lifecycle') AS n_lifecycle", ERRORS))
def _(v):
    return plain(workload.error_log_summary(parse.error_log_lines(error_texts(v))))


@check("sql_09_error_log_tail", f"""SELECT cluster_id, node_ip, severity, line_no, CAST(r AS INT) AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, node_ip, severity ORDER BY line_no DESC) AS r FROM ({ERRORS}) WHERE severity IS NOT NULL)
WHERE r <= CASE severity WHEN 'warning' THEN 10 ELSE 20 END""")
def _(v):
    tail = workload.error_log_tail(parse.error_log_lines(error_texts(v)))
    return plain(tail.drop("line")).withColumn("line_no", F.col("line_no").cast("bigint"))


@check("src_20_storage_footprint", f"""
SELECT {K}, CASE WHEN k % 2 = 0 THEN slow_log_bytes END AS slow_log_bytes, binlog_bytes, concat('/data/b', k) AS binlog_dir, data_bytes, relay_bytes, concat('/data/r', k) AS relay_dir FROM {{nodes}}""")
def _(v):
    def gib(name):
        return F.floor(F.col(name) / GIB)

    slow = F.when(F.col("k") % 2 == 0, F.concat(F.lit("file size: "), gib("slow_log_bytes").cast("string"), F.lit("G"))).otherwise("(none)")
    total = f"\n{fv.TOTAL_SIZE_LABEL}: "
    dumps = D.node_dumps(
        v, D.section(10, "Slow query log status", "slow_query_log: 1\n", slow), D.section(11, "Binlog directory", "binlog dir: /data/b", F.col("k"), total, gib("binlog_bytes"), "G\ntotal 5"),
        D.section(11, "Datadir size", "datadir: /data", total, gib("data_bytes"), "G"), D.section(11, "Relay log directory", "relay log dir: /data/r", F.col("k"), total, gib("relay_bytes"), "G"))
    found = facts(dumps, "Slow query log status", "Binlog directory", "Datadir size", "Relay log directory")
    return plain(found.select(*KEYS, "slow_log_bytes", "binlog_bytes", "binlog_dir", "data_bytes", "relay_bytes", "relay_dir"))


@check("src_21_backup_tools", f"SELECT {K}, 'mysqldump' AS tool, k % 2 = 0 AS installed, concat('/bin/', k) AS detail FROM {{nodes}} UNION ALL SELECT {K}, 'mydumper', FALSE, 'NOT FOUND' FROM {{nodes}}")
def _(v):
    flag = F.when(F.col("k") % 2 == 0, "[OK]").otherwise("[--]")
    dumps = D.node_dumps(v, D.section(11, "Backup tools available", "", flag, " mysqldump: /bin/", F.col("k"), "\nVer 10\n[--] mydumper: NOT FOUND"))
    return plain(parse.backup_tools(parsed(dumps, "Backup tools available")))


@check("src_22_cron_lines", f"SELECT {K}, 'root' AS source, concat('0 1 * * * job', k) AS line FROM {{nodes}} UNION ALL SELECT {K}, 'system', 'x' FROM {{nodes}}")
def _(v):
    dumps = D.node_dumps(v, D.section(11, "Crontab for root", "0 1 * * * job", F.col("k")), D.section(11, "System cron files for backup", "x\n"))
    return plain(parse.cron_lines(parsed(dumps, "Crontab for mysql user", "Crontab for root", "System cron files for backup")))


def backup_dumps(v) -> DataFrame:
    found = F.concat(F.date_format("mtime", "yyyy-MM-dd"), F.lit("+01:02:03.5 "), F.col("bytes").cast("string"), F.lit(" "), F.col("path"))
    numbered = v["backup_files"].withColumn("n", F.regexp_extract("path", r"(\d+)", 1).cast("bigint"))
    body = F.concat(F.lit(f"===== /data/backup =====\n{fv.TOTAL_SIZE_LABEL}: 9G\n"), F.array_join("entries", "\n"), F.lit(f"\n[--] /opt/none {fv.MISSING_LABEL}\n2020-01-01+00:00:00 1 /lost"))
    return D.chunk_dumps(D.chunked(numbered, "n", found), 11, "Backup directory inspection", body)


@check("src_23_backup_files", f"""SELECT {chunk_keys("CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT)")}, '/data/backup' AS dir, path, CAST(mtime AS DATE) AS day, bytes FROM {{backup_files}}""")
def _(v):
    files = parse.backup_files(parsed(backup_dumps(v), "Backup directory inspection"))
    return plain(files.withColumn("day", F.to_date("mtime")).drop("mtime"))


@check("src_23_backup_dirs", f"""WITH d AS (SELECT {chunk_keys("CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT)")}, count(*) AS n FROM {{backup_files}} GROUP BY ALL)
SELECT cluster_id, node_ip, '/data/backup' AS path, TRUE AS is_there, '9G' AS total_size, n AS n_files FROM d UNION ALL SELECT cluster_id, node_ip, '/opt/none', FALSE, NULL, 0 FROM d""")
def _(v):
    return plain(parse.backup_dirs(parsed(backup_dumps(v), "Backup directory inspection")).withColumnRenamed("exists", "is_there"))


@check("src_24_security_evidence", f"""
SELECT {K}, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 3 = 1 END AS has_audit, CASE WHEN k % 4 = 0 THEN NULL ELSE k % 4 = 1 END AS has_password_policy, have_ssl, k % 2 = 0 AS has_empty_password,
  k % 5 = 0 AS has_login_failures, sql_mode FROM {{nodes}}""")
def _(v):
    k = F.col("k")

    def optional(condition, *sections):
        return F.when(condition, F.concat(*sections)).otherwise("")

    dumps = D.node_dumps(
        v,
        optional(k % 3 != 0, D.section(12, "Audit plugin status", F.when(k % 3 == 1, "audit_log ACTIVE").otherwise("(none)"))),
        optional(k % 4 != 0, D.section(12, "Password validation policy", F.when(k % 4 == 1, "validate_password.policy").otherwise(""))),
        optional(F.col("have_ssl").isNotNull(), D.section(12, "TLS / SSL configuration", "| Variable_name | Value |\n| have_ssl | ", F.col("have_ssl"), " |\n| Variable_name | Value |\n| tls_version | x |")),
        D.section(12, "Users with empty password", F.when(k % 2 == 0, "| user | host |\n| a | % |").otherwise("")),
        D.section(6, "failed login attempts (host_cache)", "| IP | HOST | SUM_CONNECT_ERRORS |\n| 1 | h | ", F.when(k % 5 == 0, 101).otherwise(100), " |"),
        optional(F.col("sql_mode").isNotNull(), D.section(12, "Global SQL_MODE", "| @@global.sql_mode |\n| ", F.col("sql_mode"), " |")),
    )
    found = facts(dumps, "Audit plugin status", "Password validation policy", "TLS / SSL configuration", "Users with empty password", "failed login attempts", "Global SQL_MODE")
    return plain(found.select(*KEYS, "has_audit", "has_password_policy", F.col("tls_config")["have_ssl"].alias("have_ssl"), "has_empty_password", "has_login_failures", "sql_mode"))


def typed(v, name: str, key: str, view: DataFrame, headers: list[str], *cells) -> DataFrame:
    section = parse.TABLE_SPECS[name][0]
    chunks = D.chunked(view, key, D.row(*cells))
    dumps = D.chunk_dumps(chunks, 5, section, D.box(headers, F.col("entries")))
    rows = ingest.boxed_rows(parsed(dumps, section))
    return plain(parse.typed_table(rows, name)).drop("row_no")


CK = chunk_keys("k")


@check("src_25_top_tables", f"SELECT {CK}, table_schema, table_name, CAST(data_length / 1048576 AS DOUBLE) AS size_gb, table_rows, engine FROM {{cat_tables}}")
def _(v):
    return typed(v, "top_tables", "k", v["cat_tables"], ["table_schema", "table_name", "SIZE(GB)", "table_rows", "engine"], "table_schema", "table_name", (F.col("data_length") / 1048576).cast("bigint"), "table_rows", "engine")


@check("src_25_frag_tables", f"SELECT {CK}, table_schema, table_name, table_rows, data_length, index_length, data_free, {RATE} AS frag_rate FROM {{cat_tables}}")
def _(v):
    rate = F.round(F.col("data_free") / (F.col("data_length") + F.col("index_length") + F.col("data_free")), 2)
    return typed(v, "frag_tables", "k", v["cat_tables"], ["a", "b", "c", "d", "e", "f", "fragment_rate"], "table_schema", "table_name", "table_rows", "data_length", "index_length", "data_free", rate)


@check("src_25_non_utf8_tables", f"SELECT {CK}, table_schema, table_name, table_collation FROM {{cat_tables}}")
def _(v):
    # Newer collectors may reorder columns; the header decides.
    return typed(v, "non_utf8_tables", "k", v["cat_tables"], ["TABLE_COLLATION", "TABLE_NAME", "TABLE_SCHEMA"], "table_collation", "table_name", "table_schema")


@check("src_25_users", f"SELECT {CK}, user_name, host, 'N' AS password_expired, CAST(password_last_changed AS VARCHAR) AS password_last_changed, coalesce(CAST(password_lifetime AS VARCHAR), 'NULL') AS password_lifetime, 'Y' AS account_locked FROM {{cat_users}}")
def _(v):
    return typed(v, "users", "k", v["cat_users"], ["user", "host", "password_expired", "password_last_changed", "password_lifetime", "account_locked"], "user_name", "host", F.lit("N"), "password_last_changed", "password_lifetime", F.lit("Y"))


@check("src_25_sessions", f"SELECT {chunk_keys('session_id')}, session_id, user_name, host, coalesce(db, 'NULL') AS db, command, time_s, state, 'NULL' AS info FROM {{sessions}}")
def _(v):
    return typed(v, "sessions", "session_id", v["sessions"], ["ID", "USER", "HOST", "DB", "COMMAND", "TIME", "STATE", "INFO"], "session_id", "user_name", "host", "db", "command", "time_s", "state", F.lit("NULL"))


@check("src_25_auto_increment", f"SELECT {CK}, table_schema, table_name, 'id' AS column_name, CAST(auto_increment AS VARCHAR) AS auto_increment, (k % 100) / 100.0::DOUBLE AS rate FROM {{cat_tables}} WHERE k % 100 > 50")
def _(v):
    rate = (F.col("k") % 100) / 100
    found = typed(v, "auto_increment", "k", v["cat_tables"], ["table_schema", "table_name", "column_name", "AUTO_INCREMENT", "auto_increment_rate"], "table_schema", "table_name", F.lit("id"), "auto_increment", rate)
    return found.withColumn("auto_increment", F.col("auto_increment").cast("string"))


@check("src_26_sql_by_count", f"SELECT {chunk_keys('l_orderkey * 8 + l_linenumber')}, concat('SELECT ', l_partkey) AS query, 'shop' AS db, l_suppkey AS exec_count, '1 s' AS total_latency, '2 ms' AS avg_latency FROM lineitem WHERE l_returnflag <> 'A'")
def _(v):
    lines = v["lineitem"].withColumn("n", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    query = F.when(F.col("l_returnflag") == "A", F.lit("SHOW TABLES")).otherwise(F.concat(F.lit("SELECT "), F.col("l_partkey").cast("string")))
    return typed(v, "sql_by_count", "n", lines, ["query", "db", "exec_count", "total_latency", "avg_latency"], query, F.lit("shop"), "l_suppkey", F.lit("1 s"), F.lit("2 ms"))


@check("src_26_redundant_indexes", f"SELECT {CK}, table_schema, table_name, 'ix_a' AS redundant_index, 'a' AS redundant_columns, k % 2 AS redundant_non_unique, 'ix_ab' AS dominant_index, 'a,b' AS dominant_columns, 1 AS dominant_non_unique, concat('DROP ', k) AS drop_sql FROM {{cat_tables}}")
def _(v):
    headers = ["table_schema", "table_name", "redundant_index_name", "redundant_index_columns", "redundant_index_non_unique", "dominant_index_name", "dominant_index_columns", "dominant_index_non_unique", "subpart_exists", "sql_drop_index"]
    found = typed(v, "redundant_indexes", "k", v["cat_tables"], headers, "table_schema", "table_name", F.lit("ix_a"), F.lit("a"), F.col("k") % 2, F.lit("ix_ab"), F.lit("a,b"), F.lit(1), F.lit(0), F.concat(F.lit("DROP "), F.col("k").cast("string")))
    return found.withColumn("dominant_non_unique", F.col("dominant_non_unique").cast("int"))


@check("src_25_db_sizes", f"SELECT {CK}, table_schema AS name, CAST(data_length / 1048576 AS DOUBLE) AS size_gb, false AS is_total FROM {{cat_tables}}")
def _(v):
    return typed(v, "db_sizes", "k", v["cat_tables"], ["DATABASE_NAME", "SIZE(GB)"], "table_schema", (F.col("data_length") / 1048576).cast("bigint"))


@check("src_25_partition_tables", f"SELECT {CK}, table_schema, table_name, CAST(k % 12 + 1 AS BIGINT) AS n_partitions FROM {{cat_tables}}")
def _(v):
    return typed(v, "partition_tables", "k", v["cat_tables"], ["TABLE_SCHEMA", "TABLE_NAME", "PARTITION_COUNT"], "table_schema", "table_name", F.col("k") % 12 + 1)


@check("src_25_routines", f"SELECT {CK}, table_schema AS routine_schema, concat('p', k) AS routine_name, CASE WHEN k % 2 = 0 THEN 'PROCEDURE' ELSE 'FUNCTION' END AS routine_type, 'root@%' AS definer FROM {{cat_tables}}")
def _(v):
    kind = F.when(F.col("k") % 2 == 0, "PROCEDURE").otherwise("FUNCTION")
    headers = ["ROUTINE_SCHEMA", "ROUTINE_NAME", "ROUTINE_TYPE", "DEFINER"]
    return typed(v, "routines", "k", v["cat_tables"], headers, "table_schema", F.concat(F.lit("p"), F.col("k").cast("string")), kind, F.lit("root@%"))


@check("src_25_object_counts", f"SELECT {CK}, table_schema AS db, CASE WHEN k % 3 = 0 THEN 'VIEW' ELSE 'TABLE' END AS object_type, CAST(k AS BIGINT) AS cnt FROM {{cat_tables}}")
def _(v):
    kind = F.when(F.col("k") % 3 == 0, "VIEW").otherwise("TABLE")
    return typed(v, "object_counts", "k", v["cat_tables"], ["DB_NAME", "OB_TYPE", "SUMS"], "table_schema", kind, F.col("k"))


@check("src_25_top_indexes", f"SELECT {CK}, table_schema, table_name, concat('ix_', k) AS index_name, CAST(k * 3 AS DOUBLE) AS size_mb, 'secondary' AS index_type, 'a,b' AS columns FROM {{cat_tables}}")
def _(v):
    headers = ["database_name", "table_name", "index_name", "SizeMB", "non_unique", "index_type", "column_name"]
    name = F.concat(F.lit("ix_"), F.col("k").cast("string"))
    return typed(v, "top_indexes", "k", v["cat_tables"], headers, "table_schema", "table_name", name, F.col("k") * 3, F.lit(1), F.lit("secondary"), F.lit("a,b"))


def workload_lines(v) -> DataFrame:
    return v["lineitem"].withColumns({"n": F.col("l_orderkey") * 8 + F.col("l_linenumber"), "query": F.concat(F.lit("SELECT "), F.col("l_partkey").cast("string"))})


LINE_KEYS = chunk_keys("l_orderkey * 8 + l_linenumber")
LINE = f"{LINE_KEYS}, concat('SELECT ', l_partkey) AS query, 'shop' AS db, CAST(l_suppkey AS BIGINT) AS exec_count"


@check("src_26_sql_by_latency", f"""SELECT {LINE}, '9 s' AS total_latency, '1 ms' AS avg_latency, '2 s' AS max_latency, CAST(l_partkey AS BIGINT) AS rows_examined, CAST(l_linenumber AS BIGINT) AS rows_sent,
  concat('d', l_orderkey) AS digest FROM lineitem""")
def _(v):
    headers = ["query", "db", "exec_count", "total_latency", "avg_latency", "max_latency", "rows_examined", "rows_sent", "tmp_tables", "sort_rows", "first_seen", "digest"]
    digest = F.concat(F.lit("d"), F.col("l_orderkey").cast("string"))
    return typed(
        v, "sql_by_latency", "n", workload_lines(v), headers, "query", F.lit("shop"), "l_suppkey", F.lit("9 s"), F.lit("1 ms"), F.lit("2 s"), "l_partkey", "l_linenumber",
        F.lit(0), F.lit(0), F.lit("x"), digest)


@check("src_26_sql_by_average", f"SELECT {LINE}, '3 ms' AS avg_latency, '4 s' AS total_latency FROM lineitem")
def _(v):
    headers = ["query", "db", "exec_count", "avg_latency", "total_latency"]
    return typed(v, "sql_by_average", "n", workload_lines(v), headers, "query", F.lit("shop"), "l_suppkey", F.lit("3 ms"), F.lit("4 s"))


@check("src_26_sql_no_good_index", f"SELECT {LINE}, '4 s' AS total_latency, CAST(l_linenumber AS BIGINT) AS no_index_count, CAST(0 AS BIGINT) AS no_good_index_count, CAST(l_partkey % 100 AS BIGINT) AS no_index_pct FROM lineitem")
def _(v):
    headers = ["query", "db", "exec_count", "total_latency", "no_index_count", "no_good_index_count", "no_index_pct"]
    return typed(v, "sql_no_good_index", "n", workload_lines(v), headers, "query", F.lit("shop"), "l_suppkey", F.lit("4 s"), "l_linenumber", F.lit(0), F.col("l_partkey") % 100)


@check("src_26_sql_with_temp", f"SELECT {LINE}, '4 s' AS total_latency, CAST(l_linenumber AS BIGINT) AS memory_tmp, CAST(1 AS BIGINT) AS disk_tmp, CAST(l_partkey % 100 AS BIGINT) AS disk_pct FROM lineitem")
def _(v):
    headers = ["query", "db", "exec_count", "total_latency", "memory_tmp", "disk_tmp", "tmp_disk_pct"]
    return typed(v, "sql_with_temp", "n", workload_lines(v), headers, "query", F.lit("shop"), "l_suppkey", F.lit("4 s"), "l_linenumber", F.lit(1), F.col("l_partkey") % 100)


@check("src_27_lock_counters", f"SELECT {K}, 'Innodb_row_lock_waits' AS name, CAST(k AS VARCHAR) AS value FROM {{nodes}} UNION ALL SELECT {K}, 'Table_locks_waited', '5' FROM {{nodes}}")
def _(v):
    body = D.section(7, "Lock status counters", "| VARIABLE_NAME | VARIABLE_VALUE |\n| Innodb_row_lock_waits | ", F.col("k"), " |\n| Table_locks_waited | 5 |")
    rows = ingest.boxed_rows(parsed(D.node_dumps(v, body), "Lock status counters"))
    return plain(parse.typed_table(rows, "lock_counters")).drop("row_no")


@check("src_27_lock_rows", f"SELECT {K}, CAST(k AS VARCHAR) AS trx_id, TRUE AS locks_collected FROM {{nodes}}")
def _(v):
    dumps = D.node_dumps(v, D.section(7, "INNODB TRX", "| trx_id | trx_state |\n| ", F.col("k"), " | RUNNING |"))
    sections = parsed(dumps, *parse.LOCK_SECTIONS)
    rows = parse.raw_section_rows(ingest.boxed_rows(sections), "INNODB TRX").select(*KEYS, F.col("cells")["trx_id"].alias("trx_id"))
    return plain(rows.join(parse.node_facts(sections).select(*KEYS, "locks_collected"), KEYS))


@check("src_03_other_sections", f"SELECT {K}, concat('Vendor check ', k % 7) AS section, concat('line ', k) AS text FROM {{nodes}}")
def _(v):
    """A section that no parser knows stays readable."""
    dumps = D.node_dumps(v, D.section(1, "hostname", "", F.col("hostname")), D.lines(D.marker(9, "Vendor check ").rstrip("\n"), F.col("k") % 7, "\nline ", F.col("k"), "\n"))
    return plain(ingest.other_sections(ingest.with_blocks(dumps), parse.ALL_SECTIONS)).drop("block_no").withColumn("text", F.trim(F.regexp_replace("text", "\n", "")))


@check("src_25_databases", f"SELECT {chunk_keys('n')}, name, 'utf8mb4' AS charset, 'bin' AS collation FROM (SELECT k * 4 + CASE name WHEN 'shop' THEN 0 WHEN 'pay' THEN 1 WHEN 'log' THEN 2 ELSE 3 END AS n, name FROM {{databases}} JOIN {{nodes}} USING (cluster_id, node_ip))")
def _(v):
    order = F.when(F.col("name") == "shop", 0).when(F.col("name") == "pay", 1).when(F.col("name") == "log", 2).otherwise(3)
    rows = v["databases"].join(v["nodes"].select(*KEYS, "k"), KEYS).withColumn("n", F.col("k") * 4 + order)
    return typed(v, "databases", "n", rows, ["SCHEMA_NAME", "DEFAULT_CHARACTER_SET_NAME", "DEFAULT_COLLATION_NAME"], "name", F.lit("utf8mb4"), F.lit("bin"))


@check("src_25_no_pk_tables", f"SELECT {CK}, table_schema, table_name FROM {{cat_tables}}")
def _(v):
    return typed(v, "no_pk_tables", "k", v["cat_tables"], ["TABLE_SCHEMA", "TABLE_NAME"], "table_schema", "table_name")


@check("src_25_large_columns", f"SELECT {CK}, table_schema, table_name, 'c' AS column_name, 'text' AS data_type FROM {{cat_tables}}")
def _(v):
    return typed(v, "large_columns", "k", v["cat_tables"], ["TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME", "DATA_TYPE"], "table_schema", "table_name", F.lit("c"), F.lit("text"))


@check("src_25_unused_indexes", f"SELECT {CK}, table_schema, table_name, concat('ix_', k) AS index_name FROM {{cat_tables}}")
def _(v):
    name = F.concat(F.lit("ix_"), F.col("k").cast("string"))
    return typed(v, "unused_indexes", "k", v["cat_tables"], ["object_schema", "object_name", "index_name"], "table_schema", "table_name", name)


@check("src_28_read_base_tables", "SELECT n_name, r_name, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def _(v):
    base = {n: tables.read_base_table(v.spark, f"{v.sf_dir}/{n}.parquet") for n in ("orders", "customer", "nation", "region")}
    joined = base["orders"].join(base["customer"], F.col("o_custkey") == F.col("c_custkey")).join(base["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    joined = joined.join(base["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"))


ORDERS = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_comment string"


def landed_orders(v, fmt: str) -> str:
    """The orders in a format; the comment holds separators, quotes and a line of another width every 50 rows."""
    path = f"{shared_folder(v.spark)}/orders-{fmt}-{uuid.uuid4().hex}"
    comment = F.concat(F.lit('a "b", c\td '), F.col("o_orderkey").cast("string"))
    rows = v["orders"].select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_custkey").cast("bigint").alias("o_custkey"), F.col("o_totalprice").cast("double").alias("o_totalprice"), comment.alias("o_comment"))
    writer = rows.write.options(header=True, sep="\t" if fmt == "tsv" else ",", escape='"') if fmt in ("csv", "tsv") else rows.write
    writer.format("csv" if fmt == "tsv" else fmt).save(path)
    return path


for _fmt in tables.FORMATS[1:]:

    @check(f"src_28_read_{_fmt}", "SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders")
    def _(v, fmt=_fmt):
        schema = ORDERS if fmt in tables.TEXT_FORMATS else None
        return tables.read_base_table(v.spark, landed_orders(v, fmt), fmt, schema).select("o_orderkey", "o_custkey", "o_totalprice")


@check("src_28_quarantine", """SELECT 'rows' AS kind, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey % 10 > 1
UNION ALL SELECT 'quarantine', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderkey % 10 <= 1""")
def _(v):
    """A tenth of the lines has a text for a number, another a value too many."""
    path = f"{shared_folder(v.spark)}/orders-spoilt-{uuid.uuid4().hex}"
    k = F.col("o_orderkey")
    line = F.concat_ws("\t", k.cast("string"), F.when(k % 10 == 0, "many").otherwise("7"), F.lit("1.5"), F.lit("x"), F.when(k % 10 == 1, "more"))
    v["orders"].select(line.alias("value")).write.text(path)
    # Without a header line every line is a record.
    rows, bad = tables.read_with_quarantine(v.spark, path, "tsv", ORDERS)
    key = F.split("record", "\t")[0].cast("bigint")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("k").cast("bigint").alias("keys")]
    return rows.select(F.lit("rows").alias("kind"), F.col("o_orderkey").alias("k")).unionByName(bad.select(F.lit("quarantine").alias("kind"), key.alias("k"))).groupBy("kind").agg(*sums)


@check("src_28_server_versions", f"""SELECT 'old' AS version, {K}, waiting_trx_id, blocking_trx_id FROM {{lock_wait_rows}} UNION ALL SELECT 'new', {K}, waiting_trx_id, blocking_trx_id FROM {{lock_wait_rows}}""")
def _(v):
    """The same lock waits as two server versions name their columns."""
    waits = v["lock_wait_rows"]
    old = waits.select(*KEYS, F.col("waiting_trx_id").alias("requesting_trx_id"), F.lit("l").alias("requested_lock_id"), "blocking_trx_id")
    new = waits.select(*KEYS, F.lit("INNODB").alias("ENGINE"), F.col("waiting_trx_id").alias("REQUESTING_ENGINE_TRANSACTION_ID"), F.col("blocking_trx_id").alias("BLOCKING_ENGINE_TRANSACTION_ID"))
    both = [tables.conform_to_server(df, "lock_wait_rows", KEYS).select(F.lit(name).alias("version"), "*") for name, df in (("old", old), ("new", new))]
    return plain(both[0].unionByName(both[1]))
